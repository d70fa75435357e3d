"""Queries against SQL on the smallest tables. ``tests/compare.py`` runs all of them."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck, rows_of, sql_rows

SF = "/root/testdata/sf0.001"
CHECKED = [
    "scan_http_tsv", "correlate_uid", "edge_aggregate", "edge_aggregate_prefix", "node_rollup_conn", "node_rollup", "node_features_19",
    "edge_index", "edge_matrix", "feature_drift", "drift_streak", "detect_anomalies", "write_anomaly_report", "snapshot_tumbling",
    "correlate_uid_stream", "monitor_snapshots", "neighbor_attention", "attention_encode",
    "connections_last_hour", "label_encode", "density_curve", "change_feed", "change_feed_stream",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    got = rows_of(entry.queries()[name](spark, SF))
    assert len(got) and compare(got, sql_rows(con, entry.oracle_sql()[name])) is None


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
