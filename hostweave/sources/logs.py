"""Connection, TLS and HTTP logs: tab-separated lines or JSON lines, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostweave import schemas as S
from hostweave.functions import dash_to_null, zeek_bool
from hostweave.sources.tail import stream_growing_lines


def route_log_kind(path) -> Column:
    """``conn``, ``ssl`` or ``http`` for a file that must be read, else null."""
    path = F.col(path) if isinstance(path, str) else path
    return F.nullif(F.regexp_extract(path, r"(?:^|/)(conn|ssl|http)\.log$", 1), F.lit(""))


def _is_data(line: Column) -> Column:
    return (line != "") & ~line.startswith("#")


def _field_count(line: Column) -> Column:
    # An empty field after the last tab does not count. Counting tabs is cheaper than splitting,
    # and the filter then runs before any field is cut out.
    tabs = F.length(line) - F.length(F.translate(line, "\t", ""))
    return tabs + F.when(line.endswith("\t"), 0).otherwise(1)


def parse_lines(lines: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text lines (column ``value``) to a table of raw text fields; comments and short lines go.

    The quoting rules of a CSV reader must not apply, so lines are split on tabs only.
    """
    good = lines.filter(_is_data(F.col("value")) & (_field_count(F.col("value")) >= S.MIN_FIELDS[kind]))
    fields = good.withColumn("_f", F.split("value", "\t", -1))
    return fields.select(
        *keep, *[F.col("_f")[i].alias(name) for i, name in enumerate(S.LOG_FIELDS[kind])]
    )


def bad_rows(lines: DataFrame, kind: str) -> DataFrame:
    """Quarantine: data lines with too few fields, with the number of fields found."""
    n = _field_count(F.col("value"))
    return lines.filter(_is_data(F.col("value")) & (n < S.MIN_FIELDS[kind])).select(
        F.lit(kind).alias("kind"), F.col("value"), n.cast("bigint").alias("fields")
    )


def typed(raw: DataFrame, kind: str) -> DataFrame:
    """Raw text fields to typed columns. A value that does not parse becomes null."""
    types = S.LOG_TYPES[kind]

    def convert(name: str) -> Column:
        c = F.col(name)
        want = types.get(name)
        if name == "ts":
            return c.try_cast("double").alias(name)
        if want == "boolean":
            return zeek_bool(c).alias(name)
        if want == "array<string>":
            # a set of tags; an empty item at the end of the list does not count
            items = F.split(c, ",", -1)
            items = F.when(F.element_at(items, -1) == "", F.slice(items, 1, F.size(items) - 1)).otherwise(items)
            return F.array_distinct(items).alias(name)
        if want:
            return dash_to_null(c).try_cast(want).alias(name)
        return c

    extra = [c for c in raw.columns if c not in S.LOG_FIELDS[kind]]
    return raw.select(*extra, *[convert(n) for n in S.LOG_FIELDS[kind]])


def _from_json_names(df: DataFrame) -> DataFrame:
    renamed = {
        "id.orig_h": "id_orig_h", "id.orig_p": "id_orig_p",
        "id.resp_h": "id_resp_h", "id.resp_p": "id_resp_p",
    }
    return df.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in df.columns])


def parse_json_lines(lines: DataFrame) -> DataFrame:
    """JSON text lines (column ``value``) of the connection log to typed columns."""
    parsed = lines.select(F.from_json("value", S.CONN_JSON_SCHEMA).alias("_j"))
    return _from_json_names(parsed.select("_j.*"))


def json_as_raw(conn: DataFrame) -> DataFrame:
    """Typed JSON rows in the raw text form of the tab-separated log, so both join the same way."""

    def back(name: str) -> Column:
        c = F.col(name)
        if S.LOG_TYPES["conn"].get(name) == "boolean":
            return F.when(c, "T").otherwise("F").alias(name)
        return F.coalesce(c.cast("string"), F.lit("-")).alias(name)

    return conn.select(*[back(n) for n in S.CONN_FIELDS])


def scan_logs(
    spark: SparkSession, path: str, kind: str, fmt: str = "tsv", recursive: bool = True,
    pattern: str | None = None,
) -> DataFrame:
    """Read one kind of log below a folder. ``pattern`` overrides the file name rule."""
    reader = spark.read.option("pathGlobFilter", pattern or f"{kind}.log").option("recursiveFileLookup", str(recursive).lower())
    if fmt == "json":
        if kind != "conn":
            raise ValueError("JSON lines are supported for the conn log only")
        return _from_json_names(reader.schema(S.CONN_JSON_SCHEMA).json(path))
    if fmt != "tsv":
        raise ValueError(f"unknown log format: {fmt}")
    return parse_lines(reader.text(path), kind)


def scan_lines(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """All log lines below a folder with the kind their file name gives; other files are skipped."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    return lines.select("value", route_log_kind(F.input_file_name()).alias("kind")).filter("kind is not null")


def stream_logs(
    spark: SparkSession, path: str, kind: str, pattern: str | None = None,
    max_files_per_trigger: int | None = None, growing: bool = False,
) -> DataFrame:
    """Stream of raw fields of one kind of log.

    Files already there and files that come later are read once each; the offsets live in the
    checkpoint of the query. Such logs must be rotated into the folder. With ``growing`` files may be
    appended to in place and may be cut: see ``tail.growing_lines`` (``pattern`` is then a file name).
    """
    if growing:
        return parse_lines(stream_growing_lines(spark, path, [pattern or f"{kind}.log"]), kind)
    reader = spark.readStream.option("pathGlobFilter", pattern or f"{kind}.log").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_lines(reader.text(path), kind)
