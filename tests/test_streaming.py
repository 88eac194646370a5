"""Streaming jobs: late data is dropped and counted; replays are idempotent."""

import datetime as dt
import os
import tempfile

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from orderpulse.operators import models as mdl

from orderpulse.plans import catalog
from orderpulse.streaming import jobs as st
from tests.landing import land_events

SF = "/root/testdata/sf0.001"


def test_late_rows_dropped_and_counted(spark):
    base = tempfile.mkdtemp(prefix="op-late-")
    ev = catalog._events(spark, SF)
    land_events(ev, f"{base}/landing", 4)
    # a late delivery: the first day's events arrive after everything else
    first_day = ev.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz"))
    n_late = first_day.count()
    first_day.select(F.col("event_id").alias("order_id"), F.col("ts").cast("timestamp").alias("event_ts"),
                     "event_type", "value", "user_id").coalesce(1).write.mode("append").parquet(f"{base}/landing")
    src = st.file_stream(spark, f"{base}/landing", catalog.EVENT_SCHEMA, 1)
    q = st.stream_window_stats(src, f"{base}/out", f"{base}/_ckpt")
    st.run_available_now(q)
    # counted at the stateful operator's input: after partial aggregation,
    # one row per late (window, event_type) group
    late_groups = first_day.select("event_type").distinct().count()
    assert n_late > 0 and st.dropped_late_rows(q) == late_groups
    out = st.latest_per_key(spark, f"{base}/out", ["window_start", "event_type"], catalog.WINDOW_SCHEMA)
    assert out.agg(F.sum("n")).first()[0] == ev.count()  # late copies not counted twice


def test_foreach_batch_replay_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="op-idem-")
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    st._write_batch(df, 3, base)
    st._write_batch(df, 3, base)  # a replayed micro-batch
    st._write_batch(df.limit(2), 4, base)
    back = spark.read.parquet(base)
    assert back.where("batch_id = 3").count() == 5 and back.count() == 7
    assert os.path.isdir(os.path.join(base, "batch_id=3"))


def test_landing_in_parallel_files_keeps_every_row(spark):
    """Ranges written as several range-partitioned files each; reading
    whole ranges per trigger loses and duplicates nothing."""
    base = tempfile.mkdtemp(prefix="op-land-")
    ev = catalog._events(spark, "/root/testdata/sf0.01")
    k = 3
    land_events(ev, f"{base}/landing", 4, files=k, duplicate_last=True)
    files = [f for f in os.listdir(f"{base}/landing") if f.endswith(".parquet")]
    assert len(files) == 5 * k
    src = st.file_stream(spark, f"{base}/landing", catalog.EVENT_SCHEMA, 2 * k)
    q = st.stream_dedup(src, f"{base}/out", f"{base}/_ckpt")
    st.run_available_now(q)
    assert len(q.recentProgress) >= 3  # 15 files, 6 per trigger
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == ev.count() == out.select("order_id").distinct().count()


def test_empty_quarantine_reads_as_no_rows(spark):
    base = tempfile.mkdtemp(prefix="op-quar-")
    empty = spark.createDataFrame([], catalog.QUARANTINE_SCHEMA)
    st._write_batch(empty, 0, base)
    assert catalog.read_sink(spark, base, catalog.QUARANTINE_SCHEMA).count() == 0
    log = st.latest_per_key(spark, base, ["order_id"], catalog.QUARANTINE_SCHEMA)
    assert log.count() == 0


def _land(spark, rows, path, late=()):
    day = lambda d, h=12: dt.datetime(2024, 1, d, h, tzinfo=dt.timezone.utc)
    make = lambda xs: spark.createDataFrame(
        [(i, day(d), t, v, None) for i, d, t, v in xs], catalog.EVENT_SCHEMA)
    st.land_feed(make(rows), path, ranges=3, late=make(late) if late else None)
    return st.file_stream(spark, path, catalog.EVENT_SCHEMA, 1)


def test_final_windows_are_written_once_and_every_late_row_is_logged(spark, tmp_path):
    rows = [(i, 1 + i // 4, "a", float(i)) for i in range(40)]
    late = [(100 + i, 1, "a", 9.0) for i in range(7)]
    src = _land(spark, rows, f"{tmp_path}/feed", late)
    with st.progress_logged(spark, f"{tmp_path}/log", "late-test"):
        st.run_available_now(st.stream_windows_final(src, f"{tmp_path}/out", f"{tmp_path}/ck", name="late-test"))
    out = spark.read.schema(catalog.WINDOW_SCHEMA).parquet(f"{tmp_path}/out").collect()
    assert sorted((r["window_start"].day, r["n"]) for r in out) == [(1 + d, 4) for d in range(10)]
    log = spark.read.schema(st.PROGRESS).parquet(f"{tmp_path}/log")
    assert log.agg(F.sum("n_late")).first()[0] == len(late)
    assert log.agg(F.sum("n_input")).first()[0] == len(rows) + len(late) + 2
    assert log.select("batch_id").distinct().count() >= 5


def test_progress_log_writes_more_reports_than_spark_keeps(spark, tmp_path):
    class Report:
        def __init__(self, i):
            op = type("Op", (), {"numRowsDroppedByWatermark": 1})()
            self.progress = type("P", (), {"name": "q", "runId": "r", "batchId": i, "numInputRows": 2,
                                           "stateOperators": [op, op]})()
    log = st.ProgressLog(spark, f"{tmp_path}/log", {"q"}, every=100)
    for i in range(230):
        log.onQueryProgress(Report(i))
    log.onQueryTerminated(type("T", (), {"runId": "r"})())
    got = spark.read.schema(st.PROGRESS).parquet(f"{tmp_path}/log")
    assert got.count() == 230 and got.agg(F.sum("n_late")).first()[0] == 460 and log.ended.is_set()


def test_red_runs_go_on_over_micro_batches_and_end_at_gaps(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    judged = spark.createDataFrame(
        [("a", day(5), 0.5), ("a", day(6), 0.3), ("a", day(7), 0.1), ("a", day(8), 0.4),
         ("b", day(6), 0.9), ("c", day(5), 0.9), ("d", day(5), 0.2), ("d", day(7), 0.2)],
        "feature string, window_start timestamp, psi double")
    before = spark.createDataFrame(
        [("a", day(4), 2), ("b", day(4), 3), ("c", day(4), 0), ("e", day(4), 1)],
        "feature string, window_start timestamp, red_run int")
    got = {(r["feature"], r["window_start"].day): r["red_run"]
           for r in st._red_runs(judged, before, "1 day").where("psi is not null").collect()}
    assert got == {("a", 5): 3, ("a", 6): 4, ("a", 7): 0, ("a", 8): 1, ("b", 6): 1, ("c", 5): 1,
                   ("d", 5): 1, ("d", 7): 1}


def test_psi_state_holds_over_batches_and_expires(spark, tmp_path):
    rows = [(i, 1 + i // 10, t, 0.5 if i // 10 < 2 or t == "b" else 9.0)
            for t, base in (("a", 0), ("b", 1000)) for i in range(100) if not (t == "b" and i >= 20)]
    rows = [(i if t == "a" else 1000 + i, d, t, v) for i, d, t, v in rows]
    src = _land(spark, rows, f"{tmp_path}/feed")
    ref = spark.createDataFrame([("a", [1.0], [1.0, 0.0]), ("b", [1.0], [1.0, 0.0])],
                                "feature string, edges array<double>, shares array<double>")
    st.run_available_now(st.stream_psi(src, ref, f"{tmp_path}/out", f"{tmp_path}/ck", feature="event_type",
                                       keep="3 days", name="psi-test"))
    got = {(r["feature"], r["window_start"].day): r["red_run"]
           for r in spark.read.schema(st.DRIFT_SCHEMA).parquet(f"{tmp_path}/out").collect()}
    assert got == {**{("a", d): max(0, d - 2) for d in range(1, 11)}, ("b", 1): 0, ("b", 2): 0}
    state = spark.read.schema(st.RUN_SCHEMA + ", batch_id bigint").parquet(f"{tmp_path}/out-state")
    last = state.agg(F.max("batch_id")).first()[0]
    assert [r["feature"] for r in state.where(F.col("batch_id") == last).collect()] == ["a"]


def test_left_join_writes_unlabelled_predictions_when_their_time_is_over(spark, tmp_path):
    src = _land(spark, [(i, 1 + i, "a", 1.0) for i in range(12)], f"{tmp_path}/feed")
    ts = F.col("event_ts")
    preds = src.select("order_id", ts.alias("scored_ts"), F.lit(0.5).alias("y_proba"), F.lit(1).alias("y_pred"))
    labels = src.where("order_id is null or order_id % 3 <> 1").select(
        "order_id", (F.col("order_id") * 10).alias("review_id"), F.lit(5).alias("review_score"),
        (ts + F.make_dt_interval(F.lit(0), F.when(F.col("order_id") % 3 == 2, 200).otherwise(24))).alias("review_ts"))
    st.run_available_now(st.stream_label_join(preds, labels, f"{tmp_path}/out", f"{tmp_path}/ck",
                                              how="leftOuter", name="left-test"))
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["order_id"], r["review_id"]) for r in got if r["review_id"] is not None) == [
        (i, i * 10) for i in range(0, 12, 3)]
    assert sorted(r["order_id"] for r in got if r["review_id"] is None) == [i for i in range(12) if i % 3]


def test_a_micro_batch_keeps_the_model_version_it_began_with(spark, tmp_path):
    model = Pipeline(stages=[]).fit(spark.range(1))
    store, pins = f"{tmp_path}/store", f"{tmp_path}/pins"
    assert mdl.versions(spark, store) == []
    assert mdl.publish(spark, model, store) == 1
    assert mdl.pinned_version(spark, store, pins, 0) == 1
    assert mdl.publish(spark, model, store) == 2
    assert mdl.pinned_version(spark, store, pins, 0) == 1  # a replay
    assert mdl.pinned_version(spark, store, pins, 1) == 2
    assert mdl.pinned_version(spark, store, pins, 2, version=1) == 1
    assert mdl.versions(spark, store) == [1, 2]
    assert mdl.load_version(spark, store, 2) is mdl.load_version(spark, store, 2)
