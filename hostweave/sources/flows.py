"""Network-flow view over the star-schema test tables.

The test tables hold no network logs, so the operators run on flows derived from ``lineitem`` and
``orders``. The text is written once with a placeholder for the one function whose name differs
between Spark SQL and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SNAPSHOT_SECONDS = 90 * 86400

FLOW_SQL = """
select *,
  epoch - epoch % 7776000 as snapshot_ts,
  case when orig_bytes = '-' then '-' else cast(cast(orig_bytes as bigint) + 40 * orig_pkts as varchar(20)) end as orig_ip_bytes,
  cast(cast(resp_bytes as bigint) + 40 * resp_pkts as varchar(20)) as resp_ip_bytes
from (
select
  concat('C',l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',cast(floor(l_quantity) as bigint)) as uid,
  {epoch_day} * 86400 + (l_orderkey * 37 + l_linenumber * 613 + l_partkey * 7) % 86400 as epoch,
  concat('10.0.0.',o_custkey % 50) as src_ip,
  1024 + l_orderkey % 60000 as src_port,
  concat('10.0.0.',l_suppkey % 60) as dst_ip,
  case l_partkey % 6 when 0 then 80 when 1 then 443 when 2 then 53
                     when 3 then 2525 when 4 then 8443 else 22 end as dst_port,
  case l_returnflag when 'A' then 'tcp' when 'N' then 'udp' else 'icmp' end as protocol,
  case l_partkey % 6 when 0 then 'http' when 1 then 'ssl' when 2 then 'dns'
                     when 3 then 'ssl,smtp' when 4 then '-' else 'ssh' end as service,
  case when l_quantity < 3 then '-'
       else cast(cast(floor(l_extendedprice) as bigint) as varchar(20)) end as orig_bytes,
  cast(cast(floor(l_extendedprice * (1 - l_discount)) as bigint) as varchar(20)) as resp_bytes,
  cast(floor(l_quantity) as bigint) as orig_pkts,
  cast(floor(l_quantity) as bigint) + l_linenumber as resp_pkts,
  case l_linenumber % 7 when 0 then 'SF' when 1 then 'S0' when 2 then 'REJ' when 3 then 'RSTO'
                        when 4 then 'OTH' when 5 then 'S1' else 'SH' end as conn_state,
  case when l_linestatus = 'O' then 'T' else 'F' end as local_orig,
  case when l_linestatus = 'F' then 'T' else 'F' end as local_resp,
  case when l_partkey % 6 in (1, 3) then
    case l_suppkey % 5 when 0 then 'TLSv12' when 1 then 'TLSv13' when 2 then 'TLSv10'
                       when 3 then 'SSLv3' else '-' end end as ssl_version,
  case when l_partkey % 6 in (1, 3) then concat('TLS_SUITE_', l_partkey % 7) end as ssl_cipher,
  case when l_partkey % 6 in (1, 3) then case when l_suppkey % 2 = 0 then 'x25519' else '-' end end as ssl_curve,
  case when l_partkey % 6 in (1, 3) then case when l_orderkey % 3 = 0 then concat('host', l_partkey % 11, '.example') else '-' end end as ssl_server_name,
  case when l_partkey % 6 in (1, 3) then case when l_linenumber = 2 then 'T' else 'F' end end as ssl_resumed,
  case when l_partkey % 6 in (1, 3) then case when l_linenumber = 4 then 'close_notify' else '-' end end as ssl_last_alert,
  case when l_partkey % 6 in (1, 3) then case when l_suppkey % 3 = 0 then 'h2' else '-' end end as ssl_next_protocol,
  case when l_partkey % 6 in (1, 3) then case when l_linenumber = 3 then 'F' else 'T' end end as ssl_established,
  case when l_partkey % 6 = 0 then case l_linenumber % 2 when 0 then 'GET' else 'POST' end end as http_method,
  case when l_partkey % 6 = 0 then concat('site', l_suppkey % 13, '.example') end as http_host,
  case when l_partkey % 6 = 0 then concat('/item/', l_partkey) end as http_uri,
  case when l_partkey % 6 = 0 then case l_suppkey % 3 when 0 then '1.1' when 1 then '1.0' else '-' end end as http_version,
  case when l_partkey % 6 = 0 then
    case l_linenumber when 1 then 'Mozilla/5.0 Chrome/120 Safari/537' when 2 then 'Mozilla/5.0 Firefox/121'
                      when 3 then 'Mozilla/5.0 Version/17 Safari/605' when 4 then 'Opera/9.80'
                      when 5 then 'ExampleBot/2.1 (crawler)' when 6 then 'curl/8.4' else '-' end end as http_user_agent,
  case when l_partkey % 6 = 0 then
    case l_linenumber when 1 then '200' when 2 then '301' when 3 then '404'
                      when 4 then '500' when 5 then '-' else '200' end end as http_status_code
from lineitem join orders on l_orderkey = o_orderkey) raw_flows
"""

EPOCH_DAY_SPARK = "datediff(cast(l_shipdate as date), date'1970-01-01')"
EPOCH_DAY_DUCKDB = "date_diff('day', date '1970-01-01', cast(l_shipdate as date))"


def flow_sql(dialect: str = "spark") -> str:
    return FLOW_SQL.format(epoch_day=EPOCH_DAY_SPARK if dialect == "spark" else EPOCH_DAY_DUCKDB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow view: one row for each connection, fields as the logs spell them."""
    sql = flow_sql().replace("from lineitem join orders", "from {lineitem} join {orders}")
    return spark.sql(sql, lineitem=read_table(spark, sf_dir, "lineitem"), orders=read_table(spark, sf_dir, "orders"))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow view as flattened connections."""
    from hostweave.operators.connections import from_flows

    return from_flows(flows(spark, sf_dir))


def event_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with epoch seconds; host = user, snapshot = day."""
    events = read_table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        "event_id", "event_type", "value", "props",
        F.concat(F.lit("u"), F.col("user_id")).alias("node"),
        micros.alias("micros"),
        (F.floor(micros / F.lit(86400000000)) * 86400).cast("bigint").alias("snapshot_ts"),
    )
