"""The pipeline, stage by stage, against plain Python."""

import re
from collections import Counter

import corpus_pipeline as cp
from test_corpus_operators import near_groups, near_rows
from test_text_operators import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "source mixing", "best-fit packing"]

    def run(name, docs):
        return cp.cut(stage[name](spark, docs, SF), "test")

    named = run("language ID", docs)
    assert named.columns == docs.columns and named.count() == docs.count()  # all have words of a known language
    once = run("exact dedup", named)
    first = {}
    for r in sorted(named.collect()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(first.values())
    apart = run("n-gram Jaccard join", once)
    groups = near_groups([(r.doc_id, r.text) for r in once.collect()])
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, c in groups.values()})
    mixed = run("source mixing", apart)
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() > 0.5 * apart.count()
    check_packing(run("best-fit packing", mixed).collect(), [(r.doc_id, r.text) for r in mixed.collect()])


def test_each_stage_takes_odd_and_empty_tables(spark, odd, nothing):
    for name, f in cp.STAGES:
        assert f(spark, nothing, SF).count() == 0, name
        out = f(spark, odd, SF)
        assert name == "best-fit packing" or out.columns == odd.columns
        assert out.count() > 0, name
    kept = cp.near_duplicates(spark, odd, SF).collect()
    assert Counter(r.doc_id for r in kept)[1] == 1 and not {5, 9, 8} & {r.doc_id for r in kept}


def test_language_stage_drops_texts_without_a_leading_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = {}
    for r in sorted(docs.collect(), key=lambda r: (-len(r.text), r.doc_id)):
        long.setdefault(r.lang, r.text)
    size = min(len(t) for t in long.values())
    even = " ".join(t[:size] for t in long.values())
    two = " ".join(t[:size] for t in [*long.values()][:2])
    added = docs.limit(0).unionByName(spark.createDataFrame([(-1, "A."), (-2, even), (-3, two), (-4, "123")], "doc_id long, text string"), allowMissingColumns=True)
    assert len(long) == 4
    assert {r.doc_id for r in cp.language_id(spark, docs.unionByName(added), SF).collect() if r.doc_id < 0} == {-3}
    # the threshold follows the number of languages: an even spread is below it, a text of the only language is not
    assert all(1 / n < cp.least_score(n) < 1 for n in range(2, 200)) and cp.least_score(1) == cp.least_score(0) == 1
    one = docs.filter("lang = 'en'")
    assert cp.language_id(spark, one, SF).count() == one.count() > 0


def test_near_duplicates_keep_one_row_of_a_group_whatever_its_ids(spark):
    def text(name, changed=""):
        return " ".join([f"{name}{i}" for i in range(60)] + [changed])

    rows = [
        (None, text("a")), (None, text("a", "x")), (None, text("a", "y")),  # no ids
        (None, text("b")), (8, text("b", "x")), (9, text("b", "y")),  # an id and none
        (3, text("c")), (3, text("c", "x")), (3, text("d")),  # one id, two groups
        (4, text("e")), (4, text("e")), (None, None), (None, ""), (5, None), (5, None),  # equal rows, no words
    ]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, _row string").repartition(4)
    out = cp.near_duplicates(spark, docs, SF)
    kept = out.collect()
    assert out.columns == docs.columns and {r._row for r in kept} == {"z"}
    assert Counter((r.doc_id, r.text[0] if r.text else "") for r in kept) == {
        (None, "a"): 1, (8, "b"): 1, (3, "c"): 1, (3, "d"): 1, (4, "e"): 1, (None, ""): 2, (5, ""): 2,
    }


def test_run_is_the_chain_of_stages(spark):
    rows = cp.run(spark, SF).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) > 0
    assert near_rows()  # the helper's data is not empty
