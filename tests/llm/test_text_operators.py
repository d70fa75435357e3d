"""License scan, packing, language ID, token counts, fingerprints."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hostweave.llm import fingerprint as fp, hashing, language as lg, license_scan as ls, packing as pk, queries as Q, token_count as tc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_shingle_hashes_stand_for_shingles(texts):
    some = [*texts.values()][:60] + ["", " ", "a", "a b c d", "a b c d e", "A  B\tc d e", "a b c d e f"]
    hashed = hashing.shingle_hashes([t.encode() for t in some])
    meant = {}
    for t, h in zip(some, hashed):
        assert len(h) == len(shingles(t)) and (np.diff(h.astype(object)) > 0).all()
        meant.setdefault(frozenset(h.tolist()), set()).add(frozenset(shingles(t)))
    assert all(len(v) == 1 for v in meant.values())


# --- license scan


def common_words(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_is_an_alignment_and_finds_unique_words():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(30))]
        b = [rng.randrange(12) for _ in range(rng.randrange(30))]
        pairs = ls.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= common_words(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    for _ in range(100):  # all words unique: patience is a longest common subsequence
        a, b = rng.sample(range(30), 20), rng.sample(range(30), 20)
        a = [x for x in a if x in b]
        assert len(ls.patience(a, [x for x in b if x in a])) <= common_words(a, b)
        assert len(ls.patience(a, a)) == len(a)


def test_license_places(spark, odd, nothing):
    words = ls.TEMPLATES["MIT"].split()
    changed = " ".join(w for i, w in enumerate(words) if i % 12)
    half = " ".join(words[: len(words) // 2])
    rows = [(1, f"x y {ls.TEMPLATES['MIT line']} z {ls.TEMPLATES['MIT line'].upper()}"), (2, f"before {changed} after"), (3, half), (4, None), (5, "the license of the public work")]
    got = ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "MIT line"), (1, "MIT line"), (2, "MIT")]
    assert [(r.start_word, r.end_word) for r in got if r.doc_id == 1] == [(2, 7), (8, 13)]
    assert all(r.coverage >= 0.8 for r in got)
    assert ls.scan_licenses(odd).count() == 0 and ls.scan_licenses(nothing).count() == 0


def test_license_query_finds_every_planted_line(spark, texts):
    lines = [ls.TEMPLATES[k] for k in ls.TEMPLATES if k.endswith("line")]
    got = Q.QUERIES["op1_license_scan"](spark, SF).collect()
    want = sum(t.count(line) for t in texts.values() for line in lines)
    assert len([r for r in got if r.license.endswith("line")]) == want > 0


def test_license_query_finds_every_rights_line_of_the_texts(spark, texts):
    """The expected lines are read from the texts, not from the templates."""
    rights = re.compile(r"(?i)\b(licen[sc]ed?|rights|copyright)\b")
    lines = Counter((i, line.strip()) for i, t in texts.items() for line in (t or "").split("\n") if len(line.split()) <= 20 and rights.search(line))
    want = Counter()
    for (i, _), n in lines.items():
        want[i] += n
    assert "All rights reserved." in {line for _, line in lines}
    got = Counter(r.doc_id for r in Q.QUERIES["op1_license_scan"](spark, SF).collect())
    assert got == want


# --- token counts and packing


def pieces_of(ids, capacity=2048):
    ids = [*ids, 0]
    return [ids[i : i + capacity] for i in range(0, len(ids), capacity)]


def test_words_encode_as_the_library_does():
    library, count, ids = tc.load(Q.vocabulary()), tc.counter(Q.vocabulary()), pk.WordIds(Q.vocabulary())
    assert len(count.whole) > 10_000 and all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in sorted(count.whole)[:300])
    rng = random.Random(3)
    bits = ["a", "B", "é", "É", "ß", "'s", "'LL", "1", "²", "½", "Σ", "İ", "中", "\x85", "\xa0", "\u2028", "\x1c", "\x00", "\x0b", "<|endoftext|>", "<|startoftext|>", "_", "...", "😀", "\u0301", " ", "\n", "the", "ing", "×", "’s", "Ⅷ"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        want = library.encode(text, add_special_tokens=False).ids
        assert sum(map(count.__getitem__, text.encode().split())) == len(want), text
        assert np.frombuffer(b"".join(map(ids.__getitem__, text.encode().split())), "<u4").tolist() == want


def test_token_counts(spark, texts, odd, nothing):
    library = tc.load(Q.vocabulary())
    got = Q.QUERIES["op6_token_count"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
    rows = tc.count_tokens(odd, Q.vocabulary()).collect()
    assert len(rows) == odd.count() and sorted(r.n_tokens for r in rows)[:4] == [0, 0, 0, 0]
    assert tc.count_tokens(nothing, Q.vocabulary()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(2)
    for most_documents, most_attention in ((100, 100 * 100), (3, 100 * 100), (100, 4000)):
        lengths = np.minimum(rng.integers(1, 70, 800), int(most_attention**0.5))
        bins, offsets = pk.best_fit(lengths, 100, most_documents, most_attention, (1.0, 0.01, 0.01), rule)
        tokens, count, cost = np.bincount(bins, lengths), np.bincount(bins), np.bincount(bins, lengths.astype(float) ** 2)
        assert tokens.max() <= 100 and count.max() <= most_documents and cost.max() <= most_attention
        for b in range(bins.max() + 1):  # gapless from 0
            inside = np.flatnonzero(bins == b)
            inside = inside[np.argsort(offsets[inside])]
            assert offsets[inside].tolist() == (np.cumsum(lengths[inside]) - lengths[inside]).tolist()
    lengths = rng.integers(1, 70, 800)
    bins, _ = pk.best_fit(lengths, 100, 100, 10_000, (1.0, 0.01, 0.01), "norm")
    assert bins.max() + 1 <= -(-lengths.sum() // 100) + 1


def check_packing(rows, texts_by_row):
    """Each document's pieces with their checksums, as often as it stands in the table."""
    library = tc.load(Q.vocabulary())
    want = sorted(
        (str(i), k, 2048 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))
        for i, t in texts_by_row for k, p in enumerate(pieces_of(library.encode(t or "", add_special_tokens=False).ids))
    )
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_packing(spark, texts, odd, nothing):
    rows = Q.QUERIES["op2_best_fit_packing"](spark, SF).collect()
    assert check_packing(rows, texts.items()) <= -(-sum(r.length for r in rows) // 2048) + 1
    check_packing(pk.pack_documents(odd, Q.vocabulary()).collect(), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    small = pk.pack_documents(odd, Q.vocabulary(), 64, most_documents=2).collect()
    assert max(sum(1 for r in small if r.sequence_id == s) for s in {r.sequence_id for r in small}) == 2
    assert pk.pack_documents(nothing, Q.vocabulary()).count() == 0


# --- language ID


def test_held_out_languages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.QUERIES["op3_language_id"](spark, SF).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_mixtures_and_odd_texts(spark, texts, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lg.learn_languages(docs)
    by = {}
    for r in docs.collect():
        if len(r.text) > 1500 and r.text.count("\n") < 40:
            by.setdefault(r.lang, []).append(r.text[:1500])
    half = by["en"][0] + " " + by["de"][0]
    rows = spark.createDataFrame([(1, half), (2, by["fr"][0]), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in lg.identify_languages(rows, model).collect()}
    assert set(got[1].languages) == {"en", "de"} and 0.3 < min(got[1].shares) <= max(got[1].shares) < 0.7
    assert got[2].languages == ["fr"] and got[2].score > 0.9
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and got[3].score == 0
    assert {r.lang_pred for r in lg.identify_languages(odd, lg.learn_languages(nothing)).collect()} == {"und"}
    assert lg.identify_languages(odd, lg.learn_languages(odd)).count() == odd.count()
    assert lg.identify_languages(nothing, model).count() == 0
    assert lg.keep_identified(odd, lg.learn_languages(odd), 0.35).columns == odd.columns


def test_expectation_maximisation_raises_the_likelihood():
    rng = np.random.default_rng(0)
    like = rng.random((50, 3)) ** 4
    like /= like.sum(axis=0)
    true = np.array([0.6, 0.4, 0.0])
    counts = np.bincount(rng.choice(50, 6000, p=like @ true), minlength=50).astype(float)
    chosen, shares, _ = lg.infer_mixture(counts, like)
    assert chosen == [0, 1] and abs(shares[0] - 0.6) < 0.05


# --- fingerprints


def check_prints(rows, docs):
    order = [d for _, d in docs]
    for k, ((i, text), r) in enumerate(zip(docs, rows)):
        after = order[(k + 1) % len(order)]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, n, hashlib.sha256(edited.encode()).hexdigest())
        own, other, following = (fp.fingerprints([t.encode()])[0] for t in (text, edited, after))
        assert r.fingerprint == own.hex() and r.edited_fingerprint == other.hex()
        assert r.near_edited == fp.likeness(own, other) and r.near_next == fp.likeness(own, following)


def test_fingerprint_query(spark, texts):
    rows = sorted(Q.QUERIES["op7_fingerprint"](spark, SF).collect())
    assert len(rows) == len(texts)
    check_prints(rows, sorted(texts.items()))
    errors = []
    for r, (i, t) in zip(rows, sorted(texts.items())):
        a, b = shingles(t), shingles(t[: len(t) - len(t) // 2])
        errors.append(r.near_edited - len(a & b) / max(1, len(a)) / 1.6)  # roughly; the exact figure is tested below
    assert abs(np.mean(errors)) < 0.2


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(5)
    errors = []
    for size, share in [(s, j) for s in (5, 40, 200, 1000) for j in (0.0, 0.3, 0.8, 1.0)]:
        for _ in range(15):
            both = round(size * share)
            a = rng.integers(0, 2**63, 2 * size - both).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            x, y = np.sort(a[:size]), np.sort(np.concatenate([a[:both], a[size:]]))
            errors.append(fp.likeness(fp.fingerprint(x), fp.fingerprint(y)) - both / (2 * size - both))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_fingerprint_edges(spark, odd, nothing):
    one = spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")
    check_prints(fp.fingerprint_edits(one).collect(), [(7, "a b c d e f")])
    many = [(i, "" if i % 3 else f"text {i} of some words and more words {i}") for i in range(40)]
    rows = sorted(fp.fingerprint_edits(spark.createDataFrame(many, "doc_id long, text string").repartition(5)).collect())
    check_prints(rows, many)
    assert fp.fingerprint_edits(odd).count() == odd.count() and fp.fingerprint_edits(nothing).count() == 0
    assert fp.likeness(b"", b"") == 1.0 and fp.likeness(b"", fp.fingerprint(np.array([5], np.uint64))) == 0.0
    assert fp.add_fingerprints(odd).columns == [*odd.columns, "fingerprint"] and fp.add_fingerprints(nothing).count() == 0
