"""Exact and near duplicates, repeated passages, URL filter, mixing."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck, rows_of, sql_rows
from hostweave.llm import components as cc, exact_dedup as ed, mixing as mx, ngram_join as nj, queries as Q, suffix_dedup as sd, url_filter as uf

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    got = rows_of(entry.queries()[name](spark, SF))
    assert len(got) and compare(got, sql_rows(duck(SF), Q.ORACLES[name])) is None


# --- exact duplicates


def check_exact(df):
    rows = df.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = ed.exact_dedup(df).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert Counter((r.doc_id, sha[r.text_sha256]) for r in got) == Counter((i, t) for t, ids in groups.items() for i in ids)
    for r in got:
        t = sha[r.text_sha256]
        assert r.keep_id == least[t] and r.group_size == len(groups[t]) and (not r.kept or r.doc_id == least[t])
    assert Counter(sha[r.text_sha256] for r in got if r.kept) == Counter(groups.keys())
    kept = ed.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""))) for r in kept.collect()) == sorted(str((least[t], t)) for t in groups)


def test_exact_duplicates(spark, odd, nothing, monkeypatch):
    check_exact(odd)
    assert ed.exact_dedup(nothing).count() == 0 and ed.drop_exact_duplicates(nothing).count() == 0
    monkeypatch.setattr(ed, "HEAVY_ROWS", 4)  # groups of more than four copies are cut into parts
    rows = [(i, f"hot{' ' * (i % 3)} text" if i % 3 else f"text {i % 40}") for i in range(600)]
    check_exact(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


# --- near duplicates


def near_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        for j, n in Counter(j for g in sets[i] for j in holders[g]).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in sets[i]:
            holders[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(seed=5, clusters=60):
    rng = random.Random(seed)
    words, rows = [f"w{k}" for k in range(60)], []
    for _ in range(clusters):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 20, 40, 80, 200]))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text).title() if rng.random() < 0.3 else " ".join(text)))
    return [*rows, (len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t")]


def test_blocks_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 9))).astype(np.uint64) * np.uint64(2)]))
        both, size = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if not len(b) or 100 * both < 80 * size:
            continue
        shared = set(nj.bands_of(len(a))) & set(nj.bands_of(len(b)))
        band = min(len(a), len(b)).bit_length() - 1
        assert band in shared
        x, y = (dict(zip(*map(np.ndarray.tolist, nj.sketch_blocks(s, band)))) for s in (a, b))
        apart = sum(x.get(k) != y.get(k) for k in x.keys() | y.keys())
        assert apart <= size - both <= min(nj.budget(len(a), band), nj.budget(len(b), band)) < nj.n_blocks(band)
        assert int(np.bitwise_count((nj.short_sketch(a) ^ nj.short_sketch(b)).view(np.uint64)).sum()) <= size - both


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(nj, "LEADERS", 2)  # so that members outside the main component are compared too
    rows = near_rows()
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_groups(rows) and len(got) == len(rows)


def test_near_duplicate_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.QUERIES["op10_ngram_jaccard_join"](spark, SF).collect()}
    assert got == near_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_edges(odd, nothing):
    got = nj.ngram_jaccard_join(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (1, 5, 9)} == {1} and {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    assert {r.component_id for r in got if r.doc_id == 6} == {6} and {r.component_id for r in got if r.doc_id is None} == {None}
    assert nj.ngram_jaccard_join(nothing).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(300, 300), (400, 401), (401, 400)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(30)}, 400: 400, 401: 400}


# --- repeated passages


def removed(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        b = (t or "").encode()
        marks = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                marks[s] += 1
                marks[s + length] -= 1
            seen.add(w)
        gone = np.cumsum(marks)[: len(b)] > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def digest(r):
    return (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for _ in range(300):
        data = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 90)).astype(np.uint8)
        text = data.tobytes()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert sd.suffix_array(data).tolist() == want
        assert sd.smaller_than_next(data).tolist() == [text[i:] < text[i + 1 :] for i in range(len(text))]
    assert sd.suffix_array(np.zeros(0, np.uint8)).tolist() == []


def passages(seed=2, n=200):
    rng = random.Random(seed)
    letters = "abcde é\n"
    shared = ["".join(rng.choice(letters) for _ in range(rng.choice([99, 100, 101, 130, 300, 700]))) for _ in range(20)]
    docs = {}
    for i in range(n):
        parts = [rng.choice([rng.choice(shared), "".join(rng.choice(letters) for _ in range(rng.randrange(200))), "-" * rng.randint(90, 130), rng.choice(shared)[rng.randrange(50) :]]) for _ in range(rng.choice([0, 1, 2, 4]))]
        docs[i * 3] = "".join(parts) or None
    return docs


@pytest.mark.parametrize("often, part", [(8, 4096), (2, 3)])
def test_repeated_passages(spark, monkeypatch, often, part):
    monkeypatch.setattr(sd, "OFTEN", often)  # the small values split nearly every anchor
    monkeypatch.setattr(sd, "PART", part)
    monkeypatch.setattr(sd, "BATCH", 5000)
    docs = passages()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = sd.remove_repeats(df).collect()
    assert {r.doc_id: digest(r) for r in got} == removed(docs)
    for r in got:
        text = (docs[r.doc_id] or "").encode()
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed
        kept = b"".join(text[a:b] for a, b in zip([0, *(s.end for s in r.spans)], [*(s.begin for s in r.spans), len(text)]))
        assert hashlib.sha256(kept).hexdigest() == r.kept_sha256


def test_repeated_passages_query_and_edges(spark, odd, nothing):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: digest(r) for r in Q.QUERIES["op4_suffix_dedup"](spark, SF).collect()} == removed(docs)
    got = sd.remove_repeats(odd).collect()
    assert len(got) == odd.count() and sorted(r.n_bytes for r in got) == sorted(len((r.text or "").encode()) for r in odd.select("text").collect())
    twice = spark.createDataFrame([(5, "x" * 7 + "abc" * 60), (5, "x" * 7 + "abc" * 60)], "doc_id long, text string")
    assert sorted(r.n_removed for r in sd.remove_repeats(twice).collect()) == [177, 187]
    assert sd.remove_repeats(nothing).count() == 0


# --- URL filter


def test_urls_and_rules(spark, nothing):
    urls = ["HTTP://A.Example.NET/en/x?q#f", "https://example.com/de/", "http://sub.example.com/deutsch", "http://x.org/fr/a", "http://x.org/fr", "http://x.net", "no scheme", None, "a://b://c/d", "http://u@h.net:80/p", "http://ÄB.net/en/", "http://notexample.net/en/"]
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, outcome int")
    labels = spark.createDataFrame([], "page_id long, outcome int")
    got = [(r.host, r.path, r.rule, r.verdict) for r in uf.filter_urls(pages, labels, Q.URL_RULES).orderBy("page_id").collect()]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("sub.example.com", "/deutsch", None, "allow"),
        ("x.org", "/fr/a", "org/fr/", "allow"), ("x.org", "/fr", None, "allow"), ("x.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("b:", "//c/d", None, "allow"), ("u@h.net:80", "/p", None, "allow"), ("Äb.net", "/en/", "net/", "block"), ("notexample.net", "/en/", "net/", "block"),
    ]
    assert uf.filter_urls(pages.limit(0), labels, Q.URL_RULES).count() == 0


def test_reputation_blocks_only_credibly_bad_hosts(spark):
    rng = random.Random(6)
    pages, labels = [], []
    for h in range(30):
        bad = h < 3
        for _ in range(120 if h == 5 else 25):
            i = len(pages)
            pages.append((i, f"http://h{h}.site{h % 7}.com/a"))
            if h != 29:
                labels.append((i, int(rng.random() > (0.97 if bad else 0.15))))
    labels += [(None, 1), (3, None), (10_000, 0), labels[50]]
    frames = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, outcome int")
    got = uf.filter_urls(*frames, Q.URL_RULES).collect()
    assert len(got) == len(pages)
    assert {r.host.split(".")[0] for r in got if r.verdict == "block"} == {"h0", "h1", "h2"}
    assert 0.5 < next(r.mean for r in got if r.host.startswith("h29.")) < 0.95


# --- mixing


def plan(tokens, entropy, repeats):
    total = sum(tokens.values())
    share = {s: t / total for s, t in tokens.items() if t}

    def weights(a):
        raised = {s: p**a for s, p in share.items()}
        return {s: v / sum(raised.values()) for s, v in raised.items()}

    grid = [k / 4096 for k in range(4097)]
    least = min(grid, key=lambda a: (max(weights(a)[s] / share[s] for s in share) > repeats, a)) if repeats else 0
    fits = [a for a in grid if -sum(w * math.log(w) for w in weights(a).values()) >= entropy * math.log(len(share)) - 1e-12] if entropy else [0 if repeats else 1]
    return weights(max(least, max(fits)))


def test_mixture_meets_its_weights(spark):
    rng = random.Random(9)
    rows = []
    for s, n in (("hot", 5000), ("b", 700), ("c", 650), ("d", 40), ("blank", 5)):
        for _ in range(n):
            rows.append((len(rows), "" if s == "blank" else " ".join(["w"] * rng.randint(1, 30)), s))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    total = sum(tokens.values())
    for entropy, repeats in ((0.8, None), (None, 3.0), (0.8, 3.0)):
        want = plan(tokens, entropy, repeats)
        drawn = mx.mix_sources(df, target_entropy=entropy, most_repeats=repeats).collect()
        got, often, weight = Counter(), Counter((r.doc_id, r.source) for r in drawn), {r.source: r.weight for r in drawn}
        for r in drawn:
            got[r.source] += r.tokens
        for s, w in want.items():
            assert abs(weight[s] - w) < 2e-3 and weight[s] * total - 31 <= got[s] <= weight[s] * total + 1
            seen = Counter(often[i, s] for i, t, o in rows if o == s)
            assert max(seen) - min(seen) <= 1
            assert repeats is None or max(seen) <= math.ceil(repeats)
        assert "blank" not in got
        # of the last pass whole blocks are taken in order: at most one block is cut
        last = max(r.copy for r in drawn if r.source == "hot")
        taken = Counter(r.block for r in drawn if r.source == "hot" and r.copy == last)
        whole = Counter(r.block for r in mx.mix_sources(df, target_entropy=None, most_repeats=None).collect() if r.source == "hot")
        assert sum(taken[b] != whole[b] for b in taken) <= 1


def test_weights_of_very_many_sources(spark):
    """Ten thousand sources meet both limits, and a source more costs no more than its own rows."""
    n = 10_000
    totals = spark.range(n).select(F.concat(F.lit("s"), "id").alias("source"), (F.lit(10_000_000) / (F.col("id") + 1) + 1).cast("bigint").alias("tokens"), F.lit(5).cast("bigint").alias("n_rows"))
    for entropy, repeats in ((0.9, None), (None, 4.0), (0.9, 4.0)):
        got = mx.source_weights(totals, entropy, repeats).collect()
        total = sum(r.tokens for r in got)
        a = {r.exponent for r in got}.pop()
        raised = [(r.tokens / total) ** a for r in got]
        assert len(got) == n and abs(sum(r.weight for r in got) - 1) < 1e-9
        assert max(abs(r.weight - v / sum(raised)) for r, v in zip(got, raised)) < 1e-12
        assert all(abs(r.quota - r.weight * total) <= 0.5 + 1e-3 for r in got)
        reached = -sum(r.weight * math.log(r.weight) for r in got) / math.log(n)
        most = max(r.weight * total / r.tokens for r in got)
        if repeats:
            assert most <= repeats + 1e-6
        if entropy and not repeats:
            assert abs(reached - entropy) < 1e-9
        if repeats and not entropy:
            assert abs(most - repeats) < 1e-6


def test_weights_without_any_words(spark):
    totals = spark.createDataFrame([("a", 0, 3), ("b", 0, 1)], "source string, tokens long, n_rows long")
    assert [(r.weight, r.quota) for r in mx.source_weights(totals, 0.9, 2.0).collect()] == [(0.0, 0), (0.0, 0)]


def test_blocks_meet_in_buckets_of_a_fixed_size(spark, monkeypatch):
    """Four times the texts, at one setting, give four times the buckets; their bytes stay as they are."""
    monkeypatch.setattr(nj, "BUCKET", 1 << 16)
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))) for i in range(1200)]
    largest = []
    for n in (300, 1200):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(4)
        sets = nj.shingle_sets(docs, "doc_id", "text")
        buckets = nj.n_buckets(sets)
        posted = []
        with monkeypatch.context() as m:
            # the posted rows themselves, in place of their counts
            m.setattr(type(docs.groupBy("doc_id")), "applyInArrow", lambda self, f, schema: posted.append(self._df) or self._df)
            nj.post_blocks(docs, "text", buckets)
        by = posted[0].groupBy("bucket").agg(F.sum(F.length("keys") + F.length("sets")).alias("b"))
        largest.append((buckets, by.agg(F.max("b")).first()[0]))
    (few, a), (many, b) = largest
    assert 3.5 * few <= many <= 4.5 * few and b <= 1.3 * a


def test_mixture_edges(odd, nothing):
    drawn = mx.mix_sources(odd, target_entropy=None, most_repeats=None).collect()
    assert len(drawn) >= 10 and mx.mix_sources(nothing).count() == 0 and mx.mix_documents(nothing).count() == 0
    mixed = mx.mix_documents(odd)
    assert mixed.columns == odd.columns
    a, b = Counter(r.doc_id for r in mixed.collect()), Counter(r.doc_id for r in mx.mix_sources(odd).collect())
    assert a == b
