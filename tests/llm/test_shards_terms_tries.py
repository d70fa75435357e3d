"""Sharding, source divergence and the conversation trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hostweave.llm import divergence as dv, prefix_trie as pt, queries as Q, sharding as sh, suffix_dedup as sd

SF = "/root/testdata/sf0.001"


# --- sharding


def check_shards(docs, shards=16, **given):
    rows = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sh.shard_documents(docs, shards, **given).collect()
    facts = lambda t: (1, 0) if t is None else (len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(x for (i, t), n in rows.items() for x in [(i, *facts(t))] * n)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loads = [0] * shards
    for r in got:
        loads[r.shard] += r["size"]
    return got, loads


def test_shards_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got, loads = check_shards(docs)
    mean = sum(loads) / 16
    assert max(abs(x - mean) for x in loads) < 0.02 * mean
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_shards_of_a_hot_group(spark):
    """Two thirds of the rows are one text, more than ten shards can hold; the other groups stay whole."""
    rows = [(i, "the same text again and again" if i % 3 else f"text number {i // 9} of some length") for i in range(3000)]
    got, loads = check_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    mean = sum(loads) / 16
    assert max(abs(x - mean) for x in loads) < 0.02 * mean
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text_crc32].add(r.shard)
    assert len(by_text.pop(zlib.crc32(b"the same text again and again"))) > 10
    assert sum(len(s) > 1 for s in by_text.values()) <= 0.3 * len(by_text)


def test_shards_of_odd_tables(spark, odd, nothing):
    check_shards(odd)
    check_shards(odd, 3)
    check_shards(odd, 1)
    assert sh.shard_documents(nothing).count() == 0
    same = spark.createDataFrame([(i % 5, "x" * 50) for i in range(400)], "doc_id long, text string")
    _, loads = check_shards(same, 8)
    assert max(loads) - min(loads) <= 51


def test_propagation_on_a_graph(spark):
    """Rings of twenty nodes: far fewer links are cut than by the first placing, within the quotas."""
    nodes = spark.createDataFrame([(i, 10) for i in range(2000)], "node long, size long")
    links = [(20 * g + i, 20 * g + (i + k) % 20) for g in range(100) for i in range(20) for k in (1, 2)]
    edges = spark.createDataFrame(links, "a long, b long")
    share = 20_000 / 8
    cuts = []
    for rounds in (0, 16):
        placed = {r.node: r.shard for r in sh.propagate(nodes, edges, 8, share, rounds=rounds, slack=0.1).collect()}
        assert set(placed) == set(range(2000))
        cuts.append(sum(placed[a] != placed[b] for a, b in links))
        if rounds:
            assert max(Counter(placed.values()).values()) * 10 < share * 1.5
    assert cuts[1] < 0.5 * cuts[0]


# --- source divergence


def brute_divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(lower))
        groups.add((lang, source))
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def prices(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + math.floor(Fraction(10**9 * (c[t] + 2), total + 2 * len(kept))) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        of = {s: prices(counts[lang, s]) for s in sources}
        q = prices(whole)
        for s in sources:
            pairs = [(-sum(f(of[s][t], of[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            terms = [(-f(of[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def check_divergence(docs, least=2, top=3, **given):
    got = sorted(tuple(r) for r in dv.source_divergence(docs, least_docs=least, top=top, **given).collect())
    assert got == brute_divergence([tuple(r) for r in docs.select("lang", "source", "text").collect()], least, top)
    return got


def test_divergence_of_random_sources(spark):
    rng = random.Random(3)
    words = [f"{c}{'é' * (i % 3)}{chr(97 + i)}" for i in range(26) for c in ("x", "Straße", "Q")]
    rows = []
    for i in range(300):
        some = rng.sample(words, 12)
        rows.append((rng.choice(["en", "de"]), f"s{rng.randrange(9)}", " ".join(rng.choice(some) + rng.choice(["", "-", ", 5"]) for _ in range(rng.randrange(40)))))
    rows += [("en", "s9", None), ("en", "s10", "12 34"), ("fr", "alone", "one two one"), ("it", "a", "x"), ("it", "b", "y"), ("en", "s1", "same words here")] * 2
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    whole = check_divergence(docs)
    # many trees: four terms wide, three groups high
    assert check_divergence(docs, stripe=4, block=3) == whole and any(r[2] == "term" for r in whole)


def test_divergence_of_odd_tables(spark, odd, nothing):
    check_divergence(odd, 1, 5)
    check_divergence(odd, 100)
    assert dv.source_divergence(nothing).count() == 0


def test_prices_and_quadtree(spark):
    big = [(n, total, terms) for n in (0, 1, 10**13, 7 * 10**14) for total in (7 * 10**14, 3 * 10**15) for terms in (1, 12345)]
    df = spark.createDataFrame(big, "n long, t long, v long").select("*", dv.price("n", "t", "v").alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 2) // (r.t + 2 * r.v) for r in df.collect())
    rng = np.random.default_rng(1)
    for n_rows, n_columns, fill in ((1, 1, 1), (5, 37, 20), (33, 6, 9), (7, 64, 0), (3, 0, 0)):
        cells = np.unique(rng.integers(0, max(n_rows * n_columns, 1), fill)) if fill else np.zeros(0, np.int64)
        rows, columns = cells // max(n_columns, 1), cells % max(n_columns, 1)
        prices, zero = rng.integers(10**6, 10**9, len(cells)), rng.integers(1, 10**6, n_rows)
        x, y = np.triu_indices(n_rows, 1)
        full = np.repeat(zero[:, None], n_columns, axis=1)
        full[rows, columns] = prices
        want = [(dv.divergence(full[a], full[b])).sum() for a, b in zip(x, y)]
        assert dv.pair_values(rows, columns, prices, zero, n_columns, x, y).tolist() == want
        pair, column, empty = dv.joint_cells(dv.quadtree(rows, columns, n_rows, n_columns), x, y, n_columns)
        assert (empty + np.bincount(pair, minlength=len(x)) == n_columns).all()


# --- conversation trie


def brute_trie(rows, every):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in by.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if every else 0
        full[c] = tuple(own.get(c - int(math.fmod(c, every)), [])[:h] + turns[h:]) if every else tuple(turns)
    members, kids = defaultdict(list), Counter()
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids.update(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += not kids[k]
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(k)).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items())


def check_trie(turns, every=20):
    c = F.col("conv_id")
    given = {"base": c - c % every, "taken": F.crc32(c.cast("string")) % 4} if every else {}
    got = pt.conversation_trie(turns, **given)
    assert got.columns == pt.NODE
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in got.collect()) == brute_trie(rows, every)


def test_trie_query(spark):
    got = Counter(tuple(r) for r in entry.queries()["op13_prefix_trie"](spark, SF).select(*pt.NODE).collect())
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got == brute_trie([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()], 20)


@pytest.fixture(scope="module")
def odd_turns(spark):
    rng = random.Random(8)
    rows = [(None, 0, "user", "no conversation"), (3, None, None, None), (3, None, "user", ""), (3, 0, "user", "a b"), (3, 0, "user", "a b"), (3, 0, "user", "a  c"), (40, 1, "user", "late first turn"), (77, 5, None, "x")]
    rows += [(1000, t, "user", f"turn {t} of a very long conversation") for t in range(300)] + [(1001, t, "user", f"turn {t} of a very long conversation") for t in range(301)]
    rows += [(2000 + i, t, ["user", "assistant"][t % 2], f"said by many {t}") for i in range(60) for t in range(4)]
    rows += [(3000 + i, t, "user", f"{rng.randrange(2)} {rng.randrange(2) * 'word ' * 3}") for i in range(80) for t in range(rng.randrange(1, 7))]
    rows += [(-7, 0, "user", "below zero"), (-20, 0, "user", "base below zero"), (5000, 0, "user", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("j", "depth", "k1", "words", "size", "one", "_range", "digest", "head"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(5)


@pytest.mark.parametrize("bits", [None, 3])
def test_trie_of_odd_conversations(spark, odd_turns, monkeypatch, bits):
    """Also with a sketch so narrow that it proves almost nothing."""
    if bits:
        monkeypatch.setattr(pt, "LEAST_BITS", bits)
        monkeypatch.setattr(pt, "MOST_BITS", bits)
    check_trie(odd_turns)
    check_trie(odd_turns, None)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert pt.conversation_trie(empty).count() == 0
    # the only conversation loses its one turn and has nobody to take one from
    c = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    check_trie(spark.createDataFrame([(c, 0, "user", "gone")], empty.schema))


def test_screen_proves_singletons(spark, odd_turns):
    steps, _ = pt.whole_turns(pt.numbered_turns(odd_turns, "conv_id", "turn", "role", "text"))
    found = pt.screened(pt.prefix_digests(steps)).toPandas()
    count = found.groupby("k1")["conv_id"].transform("size")
    assert (count[~found.shared] == 1).all() and (~found.shared).sum() > 0.9 * (count == 1).sum()


def test_all_three_are_registered():
    assert {"op11_sharding", "op12_source_divergence", "op13_prefix_trie"} <= set(Q.QUERIES) and {"op12_source_divergence", "op13_prefix_trie"} <= set(Q.ORACLES)


# --- buckets that follow the input


def test_regions_meet_in_buckets_of_a_fixed_size(spark, monkeypatch):
    """Four times the text at one setting: four times the buckets, and the largest holds about as much."""
    monkeypatch.setattr(sd, "BUCKET", 1 << 14)
    rng = random.Random(9)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(2000))
    most = []
    for n in (60, 240):
        rows = [(i, text()) for i in range(n)] * 1
        docs = spark.createDataFrame([*rows, *[(n + i, t) for i, t in rows]], "id long, text string").repartition(4)
        found = sd.matched_regions(docs, sd.bucket_count(2 * 2000 * n)).groupBy(F.spark_partition_id()).count()
        assert sd.bucket_count(2 * 2000 * n) == -(-2 * 2000 * n // (1 << 14))
        most.append(found.agg(F.sum("count")).head()[0] / sd.bucket_count(2 * 2000 * n))
    assert most[1] < 1.3 * most[0]
    assert sd.bucket_count(0) == 2
