"""Graph snapshots: text statements in, text statements out, Parquet tables for everything else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostweave import schemas as S
from hostweave.functions import escape_dot, hot_index, infer_attr_type, unescape_dot
from hostweave.session import cut

_QUOTED = r'"((?:[^"\\]|\\.)*)"'
NODE_LINE = r"^\s*" + _QUOTED + r"\s*\[(.*)\];\s*$"
EDGE_LINE = r"^\s*" + _QUOTED + r"\s*->\s*" + _QUOTED + r"\s*\[(.*)\];\s*$"
# A snapshot is one file, or one folder of part files; both end in .dot.
_DOT_GLOB = "{}/*.dot"
_ATTR = r'([^=,\s]+)\s*=\s*("(?:[^"\\]|\\.)*"|[^,]*)'


def snapshot_time(name) -> Column:
    """Epoch seconds in a file name ``..._<digits>.<ext>``, null if there are none."""
    name = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.regexp_extract(name, r"_(\d+)\.", 1), F.lit("")).try_cast("bigint")


def _dot_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+\.dot)(?:/[^/]*)?$", 1)


def _with_attributes(df: DataFrame, text: str) -> DataFrame:
    """Replace the attribute text by a map ``attrs``. A comma inside quotes does not end a value; of
    a repeated name the last value counts.

    Each step is a column of its own, so that a list is cut out once however often it is used.
    """
    pairs = df.withColumn("_p", F.regexp_extract_all(text, F.lit(_ATTR), F.lit(0)))
    value = lambda p: F.trim(F.regexp_replace(p, r"^[^=]*=", ""))
    plain = lambda v: F.when(v.startswith('"'), unescape_dot(F.regexp_extract(v, "^" + _QUOTED + "$", 1))).otherwise(v)
    entries = pairs.withColumn("_e", F.transform("_p", lambda p: F.struct(
        F.trim(F.substring_index(p, "=", 1)).alias("key"), plain(value(p)).alias("value")
    )))
    keyed = entries.withColumn("_k", F.transform("_e", lambda e: e["key"]))
    last = F.filter("_e", lambda e, i: F.array_position(F.reverse("_k"), e["key"]) == F.size("_k") - i)
    unique = F.size(F.array_distinct("_k")) == F.size("_k")
    attrs = F.when(unique, F.map_from_entries("_e")).otherwise(F.map_from_entries(last))
    return keyed.withColumn("attrs", attrs).drop(text, "_p", "_e", "_k")


def _numbers(attrs: Column) -> Column:
    return F.map_filter(F.transform_values(attrs, lambda _, v: infer_attr_type(v)), lambda _, v: v.isNotNull())


def parse_nodes(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Node statements (column ``value``): node, attribute texts, and the numbers among them."""
    nodes = lines.filter(F.col("value").rlike(NODE_LINE)).select(
        *keep, unescape_dot(F.regexp_extract("value", NODE_LINE, 1)).alias("node"),
        F.regexp_extract("value", NODE_LINE, 2).alias("_a"),
    )
    return _with_attributes(nodes, "_a").withColumn("numbers", _numbers(F.col("attrs")))


def parse_edges(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Edge statements (column ``value``); parallel edges are kept."""
    edges = lines.filter(F.col("value").rlike(EDGE_LINE)).select(
        *keep, unescape_dot(F.regexp_extract("value", EDGE_LINE, 1)).alias("src"),
        unescape_dot(F.regexp_extract("value", EDGE_LINE, 2)).alias("dst"),
        F.regexp_extract("value", EDGE_LINE, 3).alias("_a"),
    )
    return _with_attributes(edges, "_a").withColumn("numbers", _numbers(F.col("attrs")))


def edges_from_attributes(edges: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed edge statements as the typed edge table, with the defaults of missing attributes."""
    text = lambda n, d: F.coalesce(F.col("attrs")[n], F.lit(d)).alias(n)
    number = lambda n, d: F.coalesce(infer_attr_type(F.col("attrs")[n]), F.lit(d)).cast("bigint")
    return edges.select(
        *keep, "src", "dst", text("protocol", "unknown"), text("service", "unknown"),
        number("dst_port", 0.0).cast("int").alias("dst_port"),
        number("count", 1.0).alias("connection_count"),
        *[number(n, 0.0).alias(n) for n in S.EDGE_SUMS],
    )


def nodes_from_attributes(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed node statements as a table with one column for each exported host feature."""
    return nodes.select(*keep, "node", *[infer_attr_type(F.col("attrs")[n]).alias(n) for n in S.EXPORTED_NODE_FEATURES])


def _snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(_DOT_GLOB.format(path.rstrip("/")))
    return lines.select("value", snapshot_time(_dot_name(F.input_file_name())).alias("snapshot_ts"))


def scan_snapshot_nodes(spark: SparkSession, path: str) -> DataFrame:
    return nodes_from_attributes(parse_nodes(_snapshot_lines(spark, path), ("snapshot_ts",)), ("snapshot_ts",))


def scan_snapshot_edges(spark: SparkSession, path: str) -> DataFrame:
    return edges_from_attributes(parse_edges(_snapshot_lines(spark, path), ("snapshot_ts",)), ("snapshot_ts",))


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """File names and epochs below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").load(_DOT_GLOB.format(path.rstrip("/"))).select("path")
    name = _dot_name(F.col("path"))
    return files.select(name.alias("name"), snapshot_time(name).alias("snapshot_ts")).distinct()


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Rows of the newest snapshot. The right side of the join is one row by construction."""
    newest = snapshots.agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return snapshots.join(F.broadcast(newest), "snapshot_ts", "left_semi")


def unprocessed_snapshots(snapshots: DataFrame, processed: DataFrame, key: str = "snapshot_ts") -> DataFrame:
    """Snapshots without an entry in the log of finished ones; failed ones have none, so they return."""
    return snapshots.join(processed.select(key), key, "left_anti")


# --- sinks ---------------------------------------------------------------------------------


def _quoted(c) -> Column:
    return F.concat(F.lit('"'), escape_dot(c), F.lit('"'))


def render_edges(edges: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One statement for each edge."""
    numbers = [("count", "connection_count")] + [(n, n) for n in S.EDGE_SUMS]
    attrs = F.concat_ws(
        ", ",
        F.concat(F.lit("protocol="), _quoted("protocol")),
        F.concat(F.lit("service="), _quoted("service")),
        F.concat(F.lit("dst_port="), _quoted(F.col("dst_port").cast("string"))),
        *[F.concat(F.lit(f"{label}="), F.col(c).cast("string")) for label, c in numbers],
    )
    return edges.select(
        *keep,
        F.concat(F.lit("  "), _quoted("src"), F.lit(" -> "), _quoted("dst"), F.lit(" ["), attrs, F.lit("];")).alias("value"),
    )


def encoded_node_columns(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Host vectors (column ``encoded``) as one column for each exported feature.

    A one-hot block is shown as the position of its 1, a scalar as its value.
    """
    out, start = [], 0
    for name, vocab in S.NODE_ENCODING.items():
        size = len(vocab) if vocab else 1
        if name in S.EXPORTED_NODE_FEATURES:
            value = hot_index("encoded", start, size) if vocab else F.col("encoded")[start]
            out.append(value.alias(name))
        start += size
    return nodes.select(*keep, "node", *out)


def render_nodes(nodes: DataFrame, features: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One statement for each host over the given feature columns (all exported ones by default)."""
    names = features or S.EXPORTED_NODE_FEATURES
    types = dict(nodes.dtypes)

    def attr(name: str) -> Column:
        value = _quoted(name) if types[name] == "string" else F.col(name).cast("string")
        return F.concat(F.lit(f"{name}="), value)

    attrs = F.concat_ws(", ", *[attr(n) for n in names])
    return nodes.select(*keep, F.concat(F.lit("  "), _quoted("node"), F.lit(" ["), attrs, F.lit("];")).alias("value"))


def render_dot(nodes: DataFrame, edges: DataFrame, features: list[str] | None = None) -> DataFrame:
    """All statements of one snapshot with a column ``part`` that orders header, hosts, edges, end."""
    spark = nodes.sparkSession
    frame = lambda part, text: spark.range(1).select(F.lit(part).alias("part"), F.lit(text).alias("value"))
    return (
        frame(0, "digraph traffic {")
        .unionByName(render_nodes(nodes, features).withColumn("part", F.lit(1)))
        .unionByName(render_edges(edges).withColumn("part", F.lit(2)))
        .unionByName(frame(3, "}"))
    )


def write_dot(nodes: DataFrame, edges: DataFrame, path: str, epoch: int, features: list[str] | None = None) -> str:
    """Write one snapshot as text below ``path``.

    The result is a folder named like a snapshot file, with as many part files as the data needs;
    part files hold the statements in order (hosts before edges), so they can be concatenated.
    """
    target = f"{path.rstrip('/')}/nw_graph_encoded_{epoch}.dot"
    lines = render_dot(nodes, edges, features)
    ordered = lines.repartitionByRange("part", "value").sortWithinPartitions("part", "value")
    ordered.select("value").write.mode("overwrite").text(target)
    return target


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "append") -> None:
    """Write snapshots to the Parquet tables ``nodes`` and ``edges``, split by ``snapshot_ts``, and then
    their times to ``finished``, the table that says which snapshots are whole.

    ``overwrite`` replaces the snapshots that are written and leaves all others alone.
    """
    root = path.rstrip("/")
    edges = cut(edges, "edges")  # read twice: the table and its times
    for name, df in (("nodes", nodes), ("edges", edges)):
        write_partitions(df, f"{root}/{name}", mode)
    mark_finished(edges.select("snapshot_ts").distinct(), root)


def write_partitions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a table split by ``snapshot_ts``; ``overwrite`` replaces only the times it holds."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_ts").parquet(path)


def mark_finished(times: DataFrame, path: str) -> None:
    """Append the times of snapshots whose tables are whole; a repeated time does no harm."""
    times.select(F.col("snapshot_ts").cast("bigint").alias("snapshot_ts")).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/finished")


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    root = path.rstrip("/")
    return spark.read.parquet(f"{root}/nodes"), spark.read.parquet(f"{root}/edges")
