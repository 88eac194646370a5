"""Results at sizes and in cases that the sample tables do not reach."""

import math

from pyspark.sql import functions as F

from orderpulse.functions import columns as C
from orderpulse.operators import drift, metrics, monitor
from orderpulse.operators import models as M
from orderpulse.plans import catalog

SF = "/root/testdata/sf0.001"


def _p(spark, d, nr, nc):
    df = spark.createDataFrame([(d, nr, nc)], "d double, nr bigint, nc bigint")
    return df.select(C.ks_pvalue("d", "nr", "nc")).first()[0]


def test_ks_pvalue_of_tiny_differences_is_one(spark):
    assert _p(spark, 1e-6, 10**6, 10**6) >= 0.99
    assert _p(spark, 1e-8, 10**8, 10**8) >= 0.99
    assert _p(spark, 0.0, 10, 10) == 1.0


def test_ks_pvalue_against_the_defining_series(spark):
    for lam in (0.4, 0.7, 0.95, 1.0, 1.2, 2.0, 3.5):
        want = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 2000))
        n = 20_000
        assert abs(_p(spark, lam / math.sqrt(n / 2), n, n) - want) < 1e-9


def test_one_moved_value_in_a_million_is_no_drift(spark):
    ref = spark.range(10**6).select(F.lit("x").alias("feature"), F.col("id").cast("double").alias("value"))
    cur = ref.withColumn("value", F.when(F.col("value") == 500_000, 500_000.5).otherwise(F.col("value")))
    row = drift.ks(ref, cur.withColumn("month", F.lit(1)), [1]).first()
    assert row.p_value >= 0.99 and row.significant == 0


def test_group_without_values_is_reported(spark):
    rows = [(m, float(i), None if m == 2 else float(i % 7)) for m in (0, 1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "month int, a double, b double")
    ref = drift.to_long(df.where("month = 0"), ["a", "b"])
    cur = drift.to_long(df.where("month > 0"), ["a", "b"], ["month"])
    psi = drift.psi_with_severity(drift.psi(ref, cur))
    got = {(r.feature, r.month): (r.psi, r.severity) for r in psi.collect()}
    assert len(got) == 4 and got["b", 2] == (None, "RED") and got["b", 1][1] == "GREEN"
    ks = {(r.feature, r.month): r for r in drift.ks(ref, cur, [1, 2]).collect()}
    assert ks["b", 2].ks_stat is None and ks["b", 2].significant == 1 and ks["b", 2].n_cur == 0
    perf = spark.createDataFrame([(1, 0.9), (2, 0.9)], "month int, f1 double")
    alert = monitor.alerts(psi.drop("severity"), perf).collect()
    assert [(r.feature_or_metric, r.month, r.value, r.severity) for r in alert] == [("b", 2, None, "RED")]
    trigger = {r.month: r for r in monitor.retrain_trigger(psi.drop("severity"), perf).collect()}
    assert trigger[2].action == "investigate"


def test_auc_of_billions_of_rows(spark, monkeypatch):
    counts = spark.createDataFrame([(0.1, 0, 4 * 10**9), (0.5, 2 * 10**9, 0), (0.05, 2 * 10**9, 0)],
                                   "_s double, _pos bigint, _neg bigint")
    monkeypatch.setattr(metrics, "_score_counts", lambda *a: counts)
    row = metrics.roc_auc(counts, "y", "s").first()
    assert row.auc == 0.5 and row.n_pos == row.n_neg == 4 * 10**9


def test_months_cover_every_reviewed_order(spark):
    f = catalog.features(spark, SF)
    assert catalog.tag_months(f).count() == f.count()
    late = f.withColumn("order_purchase_timestamp", F.lit("2003-01-05").cast("timestamp_ntz"))
    assert catalog.months_present(catalog.tag_months(late)) == [24]


def test_snap_keeps_large_values(spark):
    df = spark.createDataFrame([(2e13,), (1.23456789,), (-2e13,)], "x double")
    assert [r[0] for r in df.select(C.snap("x")).collect()] == [2e13, 1.234568, -2e13]


def test_uniform_has_52_bits(spark):
    u = spark.range(2000).select((C.hash_uniform(1, "id") * (1 << 52)).alias("u"))
    assert u.where("u % 1048576 <> 0").count() > 1900 and u.where(f"u >= {1 << 52}").count() == 0


def test_stars_after_any_white_space(spark):
    df = spark.createDataFrame([("4 stars",), (" 3 stars",), ("\t2\tstars",), ("none",), (None,)], "x string")
    assert [r[0] for r in df.select(C.parse_stars("x")).collect()] == [4, 3, 2, None, None]


def test_forest_does_not_depend_on_the_input_layout(spark):
    f = catalog.features(spark, SF)
    spec = {**M.FOREST, "numTrees": 5, "maxDepth": 6}
    got = [sorted((r.order_id, r.y_proba) for r in M.score(M.train(f.repartition(n), spec), f)
                  .select("order_id", "y_proba").collect()) for n in (4, 8)]
    assert got[0] == got[1]


def test_boosting_partitions_grow_slowly(spark):
    assert [M._boosting_partitions(n) for n in (0, 1, 118_000, 1_200_000)] == [1, 1, 10, 24]
    assert M._boosting_partitions(42_000_000) == 168  # 590 tasks a pass and 7 million rows before


def test_quantile_of_a_large_group_orders_only_the_values_near_it(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(metrics, "ROWS_PER_BUCKET", 1000)
    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 50 == 1, 7.0).otherwise(
        F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double")).alias("v"))
    v = {k: x.v.to_numpy() for k, x in df.toPandas().groupby("g")}
    assert metrics._values_near(df.select("g", F.col("v").alias("_v")), 0.5, ["g"]).count() < 200
    for near in (metrics.NEAR, -0.2):  # the second leaves the ranks outside
        monkeypatch.setattr(metrics, "NEAR", near)
        for q in (0.0, 0.01, 0.5, 0.99, 1.0) if near > 0 else (0.5,):
            got = {r.g: r.q for r in metrics.exact_quantile(df, "v", q, "g").collect()}
            assert got == {k: float(np.quantile(x, q)) for k, x in v.items()}, (q, near)
            assert metrics.exact_quantile(df, "v", q).first().q == float(np.quantile(np.concatenate(list(v.values())), q))


def test_buckets_by_raw_rows_give_the_same_auc_and_ks(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 3).cast("int").alias("month"), (F.col("id") % 7 % 2).cast("int").alias("y"),
                                  ((F.col("id") * 7919) % 1009 / 10.0).alias("s"))
    long = drift.to_long(df, ["s"], ["month"])
    def run():
        ks = drift.ks(long.where("month = 0").drop("month"), long.where("month > 0"), [1, 2, 9])
        return sorted(map(str, metrics.roc_auc(df, "y", "s", "month").collect())), sorted(map(str, ks.collect()))
    whole = run()
    monkeypatch.setattr(metrics, "ROWS_PER_BUCKET", 300)
    assert run() == whole


def test_tables_of_a_row_per_feature_are_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where their size is not known
    try:
        edges = spark.createDataFrame([("a", [1.0, 2.0])], "feature string, edges array<double>")
        rows = spark.createDataFrame([("a", 1, 1.5)], "feature string, month int, value double")
        plans = [drift._bin_counts(rows, edges, ["month"]), catalog.QUERIES["sketch_quantiles"](spark, SF)]
        assert not any("SortMergeJoin" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stars_from_word_buckets_written_before(spark):
    from orderpulse.operators import text
    docs = spark.createDataFrame([(i, None if i == 5 else f"word{i % 7} good{i % 3} Bad") for i in range(60)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, 1 + i % 5) for i in range(60)], "doc_id long, review_score int")
    got = [sorted(map(str, text.out_of_fold_stars(d, ratings).collect())) for d in (docs, text.fold_buckets(docs))]
    assert got[0] == got[1] and len(got[0]) == 60


def test_streams_join_scores_written_once(spark):
    scored = catalog.scored_orders(spark, SF)
    assert scored.inputFiles() and not any("order_features" in p for p in scored.inputFiles())
    want = catalog.feature_model(spark, SF)(catalog.features(spark, SF)).select("order_id", "y_proba", "y_pred")
    assert sorted(scored.collect()) == sorted(want.collect())
