"""Source divergence audit over a K-squared quadtree of the group-term count matrix."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.operators.scale_out import lookup_join
from hostweave.session import cut

SCALE = 1_000_000_000
STRIPE = 4096  # terms whose columns of the matrix are one tree
BLOCK = 256  # groups whose rows of the matrix are one tree
SLICE = 1 << 20  # bytes of text whose terms are counted at a time
HELD = 1_000_000  # distinct (group, term) counts that a task holds before it passes them on
CELLS = 1 << 21  # matrix cells that a set of group pairs is expanded to at a time
_TERM = np.arange(256, dtype=np.uint8)
_TERM[65:91] += 32
_TERM[[*range(65), *range(91, 97), *range(123, 128)]] = 32
_TERM_BYTES = _TERM.tobytes()


# --- counts ------------------------------------------------------------------------------------


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text: runs of ASCII letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(_TERM_BYTES).split()


def slice_counts(texts: list[bytes], groups: np.ndarray) -> pa.Table:
    """group, term, n (occurrences), df (documents) of some texts, each with the number of its group."""
    words = [terms_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
    width = max(len(flat.dictionary), 1)
    of_doc, n = np.unique(np.repeat(np.arange(len(texts)), sizes) * width + flat.indices.to_numpy(), return_counts=True)
    of_group = groups[of_doc // width] * width + of_doc % width
    order = np.argsort(of_group, kind="stable")
    first = np.flatnonzero(np.diff(of_group[order], prepend=-1))
    at = of_group[order][first]
    n, df = (np.add.reduceat(n[order], first) if len(first) else n), np.diff(first, append=len(order))
    return pa.table({"group": pa.array(at // width, pa.int64()), "term": flat.dictionary.take(pa.array(at % width, pa.int64())), "n": pa.array(n, pa.int64()), "df": pa.array(df, pa.int64())})


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents), several rows a term, from ``docs`` (lang, source, text)."""
    def emit(held: pa.Table, names: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A row for each term of a language, with its sources in lists."""
        group, term = held["group"].to_numpy(), held["term"].combine_chunks().dictionary_encode()
        langs = {x: i for i, x in enumerate(dict.fromkeys(lang for lang, _ in names))}
        lang = np.array([langs[x] for x, _ in names], np.int64)[group]
        key = lang * max(len(term.dictionary), 1) + term.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends = np.append(first, len(order)).astype(np.int32)
        sources = pa.array([x for _, x in names], pa.string()).take(pa.array(group[order]))
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (sources, held["n"].combine_chunks().take(pa.array(order)), held["df"].combine_chunks().take(pa.array(order)))]
        terms = term.dictionary.take(term.indices.take(pa.array(order[first]))).cast(pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(list(langs), pa.string()).take(pa.array(lang[order[first]])), terms, *lists], ["lang", "term", "sources", "n", "df"])
        yield from (out.slice(a, 10_000) for a in range(0, out.num_rows, 10_000))

    def merged(tables: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(tables).group_by(["group", "term"]).aggregate([("n", "sum"), ("df", "sum")])
        return whole.rename_columns(["group", "term", "n", "df"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple, int] = {}
        tables: list[pa.Table] = []
        texts, groups, size = [], [], 0
        for batch in batches:
            for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).cast(pa.binary())):
                texts.append(text.as_py())
                groups.append(numbers.setdefault(key, len(numbers)))
                size += len(texts[-1])
                if size >= SLICE:
                    tables.append(slice_counts(texts, np.array(groups, np.int64)))
                    texts, groups, size = [], [], 0
                    if sum(t.num_rows for t in tables) > 2 * HELD:
                        tables = [merged(tables)]
                        if tables[0].num_rows > HELD:
                            yield from emit(tables[0], list(numbers))
                            tables, numbers = [], {}
        if texts:
            tables.append(slice_counts(texts, np.array(groups, np.int64)))
        if tables:
            yield from emit(merged(tables), list(numbers))

    packed = docs.select("lang", "source", "text").mapInArrow(count, "lang string, term string, sources array<string>, n array<bigint>, df array<bigint>")
    each = packed.repartition("lang", "term").select("lang", "term", F.explode(F.arrays_zip("sources", "n", "df")).alias("c"))
    return each.select("lang", F.col("c.sources").alias("source"), "term", F.col("c.n").alias("n"), F.col("c.df").alias("df"))


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n of the terms that at least ``least_docs`` documents of the language have."""
    cells = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    cells = cells.withColumn("docs", F.sum("df").over(Window.partitionBy("lang", "term")))
    return cells.filter(F.col("docs") >= least_docs).select("lang", "source", "term", "n")


# --- prices ------------------------------------------------------------------------------------


def price(n: str, total: str, terms: str) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * terms)), exact: a long division in steps of three digits."""
    m = f"({total} + 2 * {terms})"
    one = f"(({n} + 2) * 1000)"
    two = f"(({one} % {m}) * 1000)"
    three = f"(({two} % {m}) * 1000)"
    return F.expr(f"1 + ({one} div {m}) * 1000000 + ({two} div {m}) * 1000 + ({three} div {m})")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) of positive whole numbers of at most 10**9 + 1."""
    return (p - q) ** 2 // (p + q)


# --- the tree ----------------------------------------------------------------------------------


def quadtree(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int) -> list[np.ndarray]:
    """Levels of a K-squared tree (K = 2) from the root to the single cells: which quadrants have a count.

    The matrix is seen as a square whose side is a power of two; a level has a bit for each of its
    quadrants that lies in the matrix.
    """
    depth = max(n_rows - 1, n_columns - 1, 0).bit_length()
    level = np.zeros((n_rows, n_columns), bool)
    level[rows, columns] = True
    levels = [level]
    for _ in range(depth):
        r, c = level.shape
        even = np.zeros((r + r % 2, c + c % 2), bool)
        even[:r, :c] = level
        level = even[0::2, 0::2] | even[1::2, 0::2] | even[0::2, 1::2] | even[1::2, 1::2]
        levels.append(level)
    return levels[::-1]


def joint_cells(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, n_columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A walk down the tree for pairs of rows at once: (pair, column) of the cells where one has a
    count, and for each pair how many columns lie in quadrants that are empty for both."""
    depth = len(levels) - 1
    pair, column = np.arange(len(x)), np.zeros(len(x), np.int64)
    empty = np.zeros(len(x), np.int64)
    for number, level in enumerate(levels):
        down = depth - number
        if number:
            pair, column = np.repeat(pair, 2), np.repeat(2 * column, 2)
            column[1::2] += 1
        inside = column < level.shape[1]
        pair, column = pair[inside], column[inside]
        live = level[x[pair] >> down, column] | level[y[pair] >> down, column]
        gone = column[~live]
        np.add.at(empty, pair[~live], np.minimum((gone + 1) << down, n_columns) - (gone << down))
        pair, column = pair[live], column[live]
    return pair, column, empty


def pair_values(rows: np.ndarray, columns: np.ndarray, prices: np.ndarray, zero: np.ndarray, n_columns: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of rows (x, y) the divergence over all columns.

    ``prices`` are those of the cells with a count, ``zero`` those of cells without, one a row. Empty
    quadrants have one price times their width.
    """
    levels = quadtree(rows, columns, len(zero), n_columns)
    matrix = np.repeat(zero[:, None], max(n_columns, 1), axis=1)
    matrix[rows, columns] = prices
    out = np.zeros(len(x), np.int64)
    step = max(1, CELLS // max(n_columns, 1))
    for a in range(0, len(x), step):
        left, right = x[a : a + step], y[a : a + step]
        pair, column, empty = joint_cells(levels, left, right, n_columns)
        value = empty * divergence(zero[left], zero[right])
        np.add.at(value, pair, divergence(matrix[left[pair], column], matrix[right[pair], column]))
        out[a : a + step] = value
    return out


def _stripe_values(table: pa.Table, block: int) -> pa.Table:
    """The share of one stripe of terms in the values of all pairs of two blocks of groups."""
    lang, n_terms = table["lang"][0].as_py(), table["n_terms"][0].as_py()
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    group, term, p = table["g"].to_numpy(), table["term"].combine_chunks(), table["p"].to_numpy()
    marks = term.is_null().to_numpy(zero_copy_only=False)
    groups = np.unique(group[marks])
    zero = np.zeros(len(groups), np.int64)
    zero[np.searchsorted(groups, group[marks])] = p[marks]
    # columns without a count in either block lie behind the others
    columns = term.filter(pa.array(~marks)).dictionary_encode().indices.to_numpy().astype(np.int64)
    rows = np.searchsorted(groups, group[~marks])
    if low == high:
        x, y = np.triu_indices(len(groups), 1)
    else:
        first = np.flatnonzero(groups // block == low)
        second = np.flatnonzero(groups // block == high)
        x, y = np.repeat(first, len(second)), np.tile(second, len(first))
    value = pair_values(rows, columns, p[~marks], zero, n_terms, x, y)
    return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "x": pa.array(groups[x], pa.int32()), "y": pa.array(groups[y], pa.int32()), "value": pa.array(value, pa.int64())})


def pair_divergence(cells: DataFrame, groups: DataFrame, stripe: int = STRIPE, block: int = BLOCK) -> DataFrame:
    """lang, source, item, value for all pairs of groups of a language, both ways round.

    ``cells`` has lang, g, term, p; ``groups`` lang, source, g (0, 1, ... in its language), zero (the
    price of a term that the group has not) and terms (of the language). The terms of a language are
    dealt into stripes of about ``stripe``, its groups into blocks of ``block``; each stripe of two
    blocks is a tree of its own, so a task holds at most 512 rows of one stripe.
    """
    stripes = F.greatest(F.lit(1), F.ceil(F.col("terms") / stripe)).cast("int")
    langs = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.max("g").alias("last"))
    langs = langs.select("lang", stripes.alias("stripes"), F.floor(F.col("last") / block).cast("int").alias("last_block"))
    dealt = lookup_join(cells, langs, ["lang"]).withColumn("stripe", F.pmod(F.xxhash64("term"), F.col("stripes")).cast("int"))
    sizes = dealt.select("lang", "stripe", "term").distinct().groupBy("lang", "stripe").agg(F.count(F.lit(1)).cast("int").alias("n_terms"))
    marks = lookup_join(groups, langs, ["lang"]).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    marks = marks.withColumn("term", F.lit(None).cast("string")).withColumnRenamed("zero", "p")
    columns = ["lang", "stripe", "last_block", "g", "term", "p"]
    both = dealt.select(*columns).unionByName(marks.select(*columns)).join(sizes, ["lang", "stripe"], "left")
    both = both.withColumn("n_terms", F.coalesce("n_terms", F.lit(0))).withColumn("own", F.floor(F.col("g") / block).cast("int"))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last_block"))))
    both = both.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    sums = both.select("lang", "stripe", "low", "high", "n_terms", "g", "term", "p").groupBy("lang", "stripe", "low", "high").applyInArrow(
        lambda table: _stripe_values(table, block), "lang string, x int, y int, value bigint",
    )
    values = cut(sums.groupBy("lang", "x", "y").agg(F.sum("value").alias("value")), "pair-values")
    turned = values.select("lang", F.col("x").alias("y"), F.col("y").alias("x"), "value")
    names = groups.select("lang", "g", "source")
    out = values.select("lang", "x", "y", "value").unionByName(turned.select("lang", "x", "y", "value"))
    out = out.join(names.select("lang", F.col("g").alias("x"), "source"), ["lang", "x"])
    return out.join(names.select("lang", F.col("g").alias("y"), F.col("source").alias("item")), ["lang", "y"]).select("lang", "source", "item", "value")


# --- the operator ------------------------------------------------------------------------------


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10,
    stripe: int = STRIPE, block: int = BLOCK,
) -> DataFrame:
    """How the word use of each source differs from that of its language's other sources, and by which terms.

    Columns lang, source, part, item, value, rank. Part 'pair': every other source of the language;
    value sums floor((p-q)**2/(p+q)) over all kept terms, p and q the sources' smoothed shares of a
    term in billionths. Part 'term': the ``top`` terms that the source has and uses more than the
    language does, with that term's value against the language. Kept are terms in at least
    ``least_docs`` documents of the language. All numbers are whole and exact.

    Texts are read once and their terms counted in the tasks that read them; what is shuffled is one
    row for each term of a task. The matrix of groups and terms is walked as K-squared quadtrees
    (``pair_divergence``): empty quadrants have one price, the others are descended by all pairs of
    sources at once. The number of pairs is that of the result.

    Cases: null text, lang and source are empty texts, of the language or source with the empty name;
    a group without terms is a group with counts of 0; a language without kept terms has values of 0
    and no terms; of equal values the smaller item in the order of UTF-8 bytes comes first; repeated
    rows are documents of their own; very long texts are counted whole; an empty table gives no rows;
    other columns are not looked at.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    cells = cut(kept_counts(docs, least_docs), "kept-counts")
    by_term = cut(cells.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "kept-terms")
    langs = by_term.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    none = F.lit(0).cast("bigint")
    groups = groups.select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "terms", "lang_total")])
    # one row per source: the sources of a language are numbered in one task
    groups = groups.withColumn("g", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))
    groups = cut(groups.withColumn("zero", F.when(F.col("terms") > 0, price("0", "total", "terms")).otherwise(none)), "groups")
    priced = lookup_join(cells, groups.select("lang", "source", "g", "total", "terms", "lang_total"), ["lang", "source"])
    priced = cut(priced.withColumn("p", price("n", "total", "terms")), "priced-counts")

    pairs = pair_divergence(priced.select("lang", "g", "term", "p"), groups.select("lang", "source", "g", "zero", "terms"), stripe, block)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    own = lookup_join(priced, by_term, ["lang", "term"]).withColumn("q", price("lang_n", "lang_total", "terms")).filter("p > q")
    own = own.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"), F.pmod(F.xxhash64("term"), F.lit(64)).alias("slice"))
    in_slice = Window.partitionBy("lang", "source", "slice").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(in_slice)).filter(F.col("rank") <= top)
    terms = own.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
