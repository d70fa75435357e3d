import numpy as np
import pytest
from pyspark.sql import functions as F

from hostweave import schemas as S
from hostweave import functions as fn
from hostweave.operators import attention, detect, drift, edges, features as ft, hosts as ho, scale_out, scaling, stats, topology as tp


def test_lookup_join_keeps_every_row_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    table = spark.createDataFrame([("hot", 1), ("4500", 2)], "k string, v int")
    assert scale_out.lookup_join(rows, table, ["k"]).count() == 4001
    assert scale_out.lookup_join(rows, table, ["k"], "left").count() == 5000
    assert scale_out.lookup_join(rows, table, ["k"], "left_semi").count() == 4001


@pytest.mark.parametrize("probs", [[0.25, 0.5, 0.75], [0.0, 0.95, 1.0]])
def test_exact_percentiles_match_numpy(spark, probs):
    rng = np.random.default_rng(1)
    data = [("a", float(v)) for v in rng.lognormal(size=3001)] + [("b", 5.0)] * 50 + [("c", 1.0), ("c", 2.0)]
    got = scale_out.exact_percentiles(spark.createDataFrame(data, "g string, v double"), "v", probs, ["g"], accuracy=100).collect()
    for r in got:
        want = np.percentile([v for g, v in data if g == r.g], [100 * p for p in probs])
        assert np.allclose(r.p, want), (r, want)
    assert len(got) == 3


def test_dense_index_is_dense_and_repeatable(spark):
    df = spark.range(777).select((F.col("id") % 2).alias("s"), F.concat(F.lit("h"), "id").alias("node")).repartition(7)
    one = {(r.s, r.node): r.idx for r in scale_out.dense_index(df, "node", ["s"]).collect()}
    two = {(r.s, r.node): r.idx for r in scale_out.dense_index(df.repartition(3), "node", ["s"], digits=1).collect()}
    assert one == two
    assert sorted(v for (s, _), v in one.items() if s == 0) == list(range(389))


def test_rolling_counts_match_brute_force(spark):
    rng = np.random.default_rng(2)
    times = sorted(int(t) * 1_000_000 for t in rng.integers(0, 9000, 400)) + [0, 60_000_000, 3600_000_000]
    df = spark.createDataFrame([("h", t) for t in times], "node string, micros bigint")
    got = {r.micros: (r.connections_last_minute, r.connections_last_hour) for r in ho.rolling_connections(df).collect()}
    for t in set(times):
        want = tuple(sum(t - w * 1_000_000 <= u <= t for u in times) for w in (60, 3600))
        assert got[t] == want


def test_self_loop_is_outgoing_only_and_tls_double_count(spark):
    e = spark.createDataFrame(
        [("a", "a", "tcp", "https", 443, 1, 1, 1, 1), ("a", "b", "tcp", "ssl", 443, 1, 1, 1, 1)],
        "src string, dst string, protocol string, service string, dst_port int, total_orig_bytes bigint, total_resp_bytes bigint, "
        "total_orig_pkts bigint, total_resp_pkts bigint",
    )
    r = {x.node: x for x in tp.node_rollup(e).collect()}
    assert (r["a"].total_connections, r["a"].incoming_connections, r["a"].ssl_connections) == (2, 0, 4)
    assert r["b"].ssl_connections == 1
    once = {x.node: x.ssl_connections for x in tp.node_rollup(e, dedupe_ssl=True).collect()}
    assert once == {"a": 2, "b": 1}


def test_scalers_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    std, _ = scaling.scale(df, ["a", "b"], "standard")
    assert [tuple(r) for r in std.orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    mm, _ = scaling.scale(df, ["a", "b"], "minmax")
    assert [tuple(r) for r in mm.orderBy("a").collect()] == [(0.0, 0.0), (1.0, 0.0)]
    flat = df.select("b")
    assert scaling.scale(flat, ["b"], "standard")[0].head().b == 5.0
    assert scaling.scale(flat, ["b"], "standard", on_constant="drop")[0].head().b is None
    with pytest.raises(ValueError):
        scaling.scale(df, ["a"], "robust")


def test_unseen_label_is_an_error(spark):
    known = ft.label_codes(spark.createDataFrame([("b",), ("a",), ("ab",)], "c string"), "c")
    assert {r.c: r.code for r in known.collect()} == {"a": 0, "ab": 1, "b": 2}
    with pytest.raises(Exception, match="unseen c: z"):
        ft.label_encode(spark.createDataFrame([("z",)], "c string"), "c", known).collect()


def test_statistics_merge_any_split_equals_the_whole(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id") % 97 + 1e6).alias("x"), (F.col("id") % 7).alias("part"))
    whole = stats.stats_update(df, ["x"]).head()
    parts = stats.stats_update(df, ["x"], ("part",)).drop("part")
    joint = stats.stats_combine(parts).head()
    two = stats.stats_merge(stats.stats_update(df.filter("part < 2"), ["x"]), stats.stats_update(df.filter("part >= 2"), ["x"])).head()
    for got in (joint, two):
        assert got.n == whole.n and np.isclose(got["mean"], whole["mean"]) and np.isclose(got.m2, whole.m2)


def test_streak_restarts_after_three(spark):
    flags = [True, True, False, True, True, True, True, False]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "snapshot_ts bigint, drift boolean")
    got = drift.drift_streak(df).orderBy("snapshot_ts").collect()
    assert [r.streak for r in got] == [1, 2, 0, 1, 2, 0, 1, 0]
    assert [r.snapshot_ts for r in got if r.triggered] == [5]


def test_replay_sample_needs_enough_snapshots(spark):
    df = spark.range(30).select(F.col("id").alias("snapshot_ts"))
    assert drift.replay_sample(df, 16, 20).count() == 16
    assert drift.replay_sample(df, 16, 10).count() == 0
    assert min(r.snapshot_ts for r in drift.replay_sample(df, 16, 20).collect()) >= 10


def test_reconstruction_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    names = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], names)
    model = detect.reconstruct_fit(df, names, 2)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    _, _, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    want = ((z - z @ vt[:2].T @ vt[:2]) ** 2).mean(1)
    got = [r.recon_error for r in detect.reconstruct_score(df, model).collect()]
    assert np.allclose(sorted(got), sorted(want), atol=1e-6)


def test_attention_layer_matches_numpy(spark):
    rng = np.random.default_rng(4)
    n, d, ed, heads, dim = 6, 4, 2, 2, 3
    layer = attention.AttentionLayer(
        weight=rng.normal(size=(heads * dim, d)), att_src=rng.normal(size=(heads, dim)), att_dst=rng.normal(size=(heads, dim)),
        att_edge=rng.normal(size=(heads, dim)), edge_weight=rng.normal(size=(heads * dim, ed)), bias=rng.normal(size=heads * dim),
        norm=(rng.normal(size=6), rng.uniform(0.5, 2, 6), rng.normal(size=6), rng.normal(size=6)),
    )
    x = rng.normal(size=(n, d))
    links = [(0, 1), (2, 1), (0, 1), (3, 3), (4, 5), (1, 0)]
    e = rng.normal(size=(len(links), ed))
    nodes = spark.createDataFrame([(str(i), [float(v) for v in x[i]]) for i in range(n)], "node string, x array<double>")
    edges = spark.createDataFrame([(str(s), str(t), [float(v) for v in e[i]]) for i, (s, t) in enumerate(links)], "src string, dst string, e array<double>")
    got = {r.node: np.array(r.x) for r in attention.neighbor_attention(nodes, edges, layer).collect()}
    h = (x @ layer.weight.T).reshape(n, heads, dim)
    kept = [(s, t, e[i]) for i, (s, t) in enumerate(links) if s != t]
    for t in range(n):
        mine = [k for k in kept if k[1] == t]
        loop = np.mean([k[2] for k in mine], axis=0) if mine else np.zeros(ed)
        out = []
        for k in range(heads):
            logit = []
            for s, _, ev in [*mine, (t, t, loop)]:
                q = h[s, k] @ layer.att_src[k] + h[t, k] @ layer.att_dst[k] + (layer.edge_weight @ ev).reshape(heads, dim)[k] @ layer.att_edge[k]
                logit.append(q if q > 0 else 0.2 * q)
            w = np.exp(np.array(logit) - max(logit))
            out.append(sum(a * h[s, k] for a, (s, *_r) in zip(w / w.sum(), [*mine, (t, t, loop)])))
        y = np.concatenate(out) + layer.bias
        m, v, g, b = layer.norm
        y = (y - m) / np.sqrt(v + layer.eps) * g + b
        y = np.where(y > 0, y, np.expm1(y))
        assert np.allclose(got[str(t)], y), t


def test_report_has_one_shape_and_keeps_every_host(spark, tmp_path):
    found = spark.range(95).select(
        F.lit(60).cast("bigint").alias("snapshot_ts"), F.concat(F.lit("h"), "id").alias("node"), F.col("id").alias("node_id"),
        F.lit("mlp").alias("detected_by"), F.lit(0.5).alias("recon_error"), F.lit(0.9).alias("mlp_score"),
    )
    counts = spark.createDataFrame([(60, 200), (120, 10)], "snapshot_ts bigint, nodes_in_graph bigint")
    rows = detect.report_rows(found, counts)
    assert sorted((r.kind, r["count"]) for r in rows.groupBy("kind").count().collect()) == [("finding", 95), ("snapshot", 2)]
    detect.write_report_rows(rows, str(tmp_path / "r"))
    back = detect.read_reports(spark, str(tmp_path / "r")).collect()
    assert sorted(r.node_id for r in back if r.snapshot_ts == 60) == list(range(95)) and {r.nodes_in_graph for r in back if r.snapshot_ts == 60} == {200}
    assert [(r.node_id, r.update_count) for r in back if r.snapshot_ts == 120] == [(None, 2)]


def test_lookup_join_spreads_a_hot_key(spark):
    """A key with 90 % of the rows is read by many tasks."""
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60000, 1, 8).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        table = spark.range(60000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        out = scale_out.lookup_join(rows, table, ["k"]).withColumn("task", F.spark_partition_id())
        tasks = out.groupBy("k", "task").agg(F.count("v").alias("count"), F.max("v")).collect()
        hot = [r for r in tasks if r["k"] == 0]
        assert sum(r["count"] for r in hot) == 54001 and len(hot) >= 8
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_percentiles_use_one_rule_for_all_sizes(spark):
    import numpy as np

    data = [("a", float(v)) for v in range(7)] + [("b", float((v * 37) % 1009)) for v in range(1009)]
    got = {r.g: r.p for r in scale_out.exact_percentiles(spark.createDataFrame(data, "g string, v double"), "v", [0.0, 0.25, 0.95, 1.0], ["g"]).collect()}
    for g in ("a", "b"):
        assert np.allclose(got[g], np.quantile([v for k, v in data if k == g], [0.0, 0.25, 0.95, 1.0]))


def test_long_status_numbers_are_ignored(spark):
    rows = spark.createDataFrame([("404",), ("12345678901",), ("99999999999999999999",), (" 200 OK",), ("x",), ("",), (None,)], "s string")
    assert [r[0] for r in rows.select(fn.status_number("s")).collect()] == [404, None, None, 200, None, None, None]


def test_moments_give_the_fitted_model(spark):
    import numpy as np

    from hostweave.operators import moments

    rng = np.random.default_rng(3)
    values = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame([(i % 3, *map(float, v)) for i, v in enumerate(values)], "snapshot_ts bigint, a double, b double, c double, d double")
    joint = moments.no_moments(4)
    for m in moments.snapshot_moments(df, list("abcd")).values():
        joint = joint.merge(moments.Moments.unpacked(m.packed()))
    ours, fitted = moments.model_of(joint, list("abcd"), 2), detect.reconstruct_fit(df, list("abcd"), 2)
    assert joint.n == 300 and np.allclose(ours.mean, fitted.mean) and np.allclose(ours.std, fitted.std)
    assert np.allclose(np.abs(ours.components), np.abs(fitted.components)) and np.allclose(ours.explained, fitted.explained)


def test_node_vector_blocks_sum_to_one(spark):
    names = ["most_freq_proto", "most_freq_conn_state", "top_proto_1", "service_1", "service_2", "service_3", "top_user_agent_1",
             "most_freq_http_version", "most_freq_ssl_version"]
    scalars = [n for n, v in S.NODE_ENCODING.items() if v is None and "_seen_hour" not in n and n != "has_ssl_resumption"]
    row = spark.range(1).select(
        F.lit("h").alias("node"), *[F.lit("weird").alias(n) for n in names], *[F.lit(2.0).alias(n) for n in scalars],
        F.lit(3).alias("ssl_resumption_count"), F.lit(3600.0).alias("first_seen"), F.lit(0.0).alias("last_seen"),
    )
    v = ft.node_one_hot(row).head().encoded
    assert len(v) == 87
    start = 0
    for n, vocab in S.NODE_ENCODING.items():
        if vocab:
            assert sum(v[start:start + len(vocab)]) == 1 and v[start + len(vocab) - 1] == 1
        start += len(vocab) if vocab else 1


def test_density_curve_equals_the_direct_sum(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 300), rng.normal(6, 0.5, 100), [2.0] * 20])
    rows = [(float(v), 3.0) for v in values] + [(None, 3.0), (float("nan"), 3.0)]
    df = spark.createDataFrame(rows, "v double, flat double")
    got = sorted((r.point, r.x, r.density) for r in stats.density_curve(df, ["v", "flat"]).collect())
    assert {r.feature for r in stats.density_curve(df, ["v", "flat"]).select("feature").distinct().collect()} == {"v"}
    x, d = np.array([g[1] for g in got]), np.array([g[2] for g in got])
    h = 0.15 * values.std(ddof=1)
    assert abs(d.sum() * h / 16 - 1) < 1e-9
    direct = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert np.abs(d - direct).max() < 2e-3 * direct.max()
    assert stats.density_curve(df.limit(0), ["v"]).count() == 0


def test_range_scan_spreads_a_hot_key(spark):
    """Nine tenths of the rows have one key: its ranks are right and come from several ranges."""
    df = spark.range(20000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("k"), (F.col("id") * 7919 % 20000).alias("o"), F.lit(1).cast("bigint").alias("one"))
    parts = df.repartitionByRange(8, "k", "o").filter("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 4
    found = scale_out.range_scan(df, ["k"], ["o"], ["one"]).filter("k = 'hot'").orderBy("o").select("one_run").collect()
    assert [r[0] for r in found] == list(range(1, 18001))


def test_prefix_weights_of_a_hot_edge_with_equal_rows(spark):
    """Weights n-i+1 by (time, uid); equal rows take neighbouring ranks."""
    schema = "timestamp double, uid string, src_ip string, dst_ip string, protocol string, service string, dst_port int, " + ", ".join(
        f"{c} bigint" for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes"))
    rng = np.random.default_rng(9)
    rows = [(float(t), f"u{u}", "a", "b", "tcp", "http", None, int(t) * 3 + u, 1, 1, 1, 1, 1) for t, u in rng.integers(0, 40, (600, 2)).tolist()]
    one = edges.edge_aggregate(spark.createDataFrame(rows, schema).repartition(5), compat="prefix").head()
    ordered = [r[7] for r in sorted(rows, key=lambda r: (r[0], r[1]))]
    assert one.total_orig_bytes == sum((len(rows) - i) * b for i, b in enumerate(ordered)) and one.dst_port is None
    assert one.connection_count == 600 * 603 // 2 and one.total_resp_pkts == 600 * 601 // 2


def test_codes_of_values_that_begin_alike(spark):
    names = [f"same-prefix-{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(n,) for n in names + [None]], "c string").repartition(6)
    assert {r.c: r.code for r in ft.label_codes(df, "c").collect()} == {n: i for i, n in enumerate(names)}
