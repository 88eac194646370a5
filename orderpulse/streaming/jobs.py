"""Structured Streaming jobs: scoring with quarantine, window statistics,
drift against fixed reference edges, deduplication and delayed labels.

All jobs read files (``readStream``), use event time with a watermark,
and write either with ``foreachBatch`` (idempotent per ``batch_id``: each
micro-batch overwrites only its own ``batch_id`` partition, so a replayed
batch after a failure leaves no duplicates) or with the file sink (exactly
once through the checkpoint). Update-mode results are read back with
:func:`latest_per_key`.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from orderpulse.functions.columns import PSI_RED, bin_index
from orderpulse.operators import models as mdl
from orderpulse.operators import validate as val

EVENT_TS = "event_ts"


# --- sources ------------------------------------------------------------------

def rows_only(ts: str = EVENT_TS) -> Column:
    """Everything but closing rows (:func:`land_feed`), for use after the watermark.
    The condition names the event time, or the optimizer would filter before the
    watermark has seen the closing rows."""
    return F.col("order_id").isNotNull() | F.col(ts).isNull()


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = 1) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_available_now(query: StreamingQuery) -> None:
    """Wait for the end of an available-now run, however long it takes."""
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))


def land_feed(rows: DataFrame, path: str, ranges: int = 6, late: DataFrame | None = None,
              files: int = 1, close: str = "60 days") -> None:
    """Land a table as a feed: ranges of event time one after the other, ``files``
    files each, then the ``late`` rows, then two closing rows (only an event time,
    ``close`` after the last one): the first moves the watermark past everything
    before it, the second brings the micro-batch that acts on it. Read it with ``files`` files per trigger, so that a micro-batch is a range."""
    lo, hi = rows.agg(F.min(EVENT_TS), F.max(EVENT_TS)).first()
    step = F.expr(f"timestamp_micros({int(lo.timestamp() * 1e6) if lo else 0})")
    width = int((hi - lo).total_seconds() * 1e6) // ranges + 1 if lo else 1
    at = F.floor((F.unix_micros(EVENT_TS) - F.unix_micros(step)) / width)
    for i in range(ranges):
        rows.where(at == i).repartition(files).write.mode("append").parquet(path)
    if late is not None:
        late.repartition(files).write.mode("append").parquet(path)
    end = rows.agg((F.max(EVENT_TS) + F.expr(f"INTERVAL {close}")).alias(EVENT_TS))
    end = end.select(*[F.col(c) if c == EVENT_TS else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    for _ in range(2):
        end.coalesce(1).write.mode("append").parquet(path)


PROGRESS = "name string, run_id string, batch_id bigint, n_input bigint, n_late bigint"


class ProgressLog(StreamingQueryListener):
    """Appends every progress report of the named queries to a table: rows read
    and rows dropped as later than the watermark. ``recentProgress`` forgets all
    but the last reports; this keeps them, ``every`` reports per file."""

    def __init__(self, spark: SparkSession, path: str, names: set[str], every: int = 50):
        self.spark, self.path, self.names, self.every = spark, path, names, every
        self.rows: list[tuple] = []
        self.runs: set[str] = set()
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name in self.names:
            self.runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name in self.names:
            self.runs.add(str(p.runId))
            late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
            self.rows.append((p.name, str(p.runId), p.batchId, p.numInputRows, late))
            if len(self.rows) >= self.every:
                self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.runs:
            self.flush()
            self.ended.set()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)


@contextmanager
def progress_logged(spark: SparkSession, path: str, name: str) -> Iterator[None]:
    """Log the reports of the query ``name`` that runs inside; on leaving, all are written."""
    log = ProgressLog(spark, path, {name})
    spark.streams.addListener(log)
    try:
        yield
        if not log.ended.wait(300):
            raise RuntimeError(f"no end of {name} was reported")
    finally:
        spark.streams.removeListener(log)


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows the stateful operators dropped as later than the watermark, summed
    over the query's recent progress reports (kept by Spark per run). For an
    aggregation these are rows after the partial (map-side) aggregation,
    i.e. late groups per micro-batch, not raw input rows.

    Spark keeps the last ``spark.sql.streaming.numRecentProgressUpdates``
    reports; when that many are held, earlier ones may be gone and the sum
    would be too small, which is an error."""
    total = 0
    reports = query.recentProgress
    held = int(SparkSession.getActiveSession().conf.get(
        "spark.sql.streaming.numRecentProgressUpdates", "100"))
    if len(reports) >= held:
        raise RuntimeError("progress reports were dropped: raise "
                           "spark.sql.streaming.numRecentProgressUpdates")
    for p in reports:
        for op in p.get("stateOperators", []) or []:
            total += int(op.get("numRowsDroppedByWatermark", 0) or 0)
    return total


def _write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def latest_per_key(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """Last emitted version of each key from an update-mode batch log; the
    ``schema`` (without batch_id) also reads a log without any row."""
    df = spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
    vals = [c for c in df.columns if c not in keys and c != "batch_id"]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*vals), "batch_id").alias("_v"))
    return last.select(*keys, "_v.*")


# --- ST1: validation + scoring with quarantine ------------------------------

def stream_score(src: DataFrame, features: DataFrame, allowed: DataFrame,
                 scorer: Callable[[DataFrame], DataFrame], out: str, quarantine: str,
                 checkpoint: str, watermark: str = "1 day") -> StreamingQuery:
    """Dedup on order_id within the watermark, attach the order's features
    (stream-static join), validate, score valid rows, quarantine the rest."""
    s = (src.withWatermark(EVENT_TS, watermark).dropDuplicatesWithinWatermark(["order_id"])
         .join(features, "order_id", "left"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        # validated once per micro-batch, then split into the two sinks
        v = val.validate_rows(batch, allowed).persist()
        try:
            good = scorer(v.where("is_valid = 1")).select("order_id", EVENT_TS, "y_proba", "y_pred")
            bad = v.where("is_valid = 0").select(
                "order_id", EVENT_TS, val.canonical_errors("errors").alias("errors"))
            _write_batch(good, batch_id, out)
            _write_batch(bad, batch_id, quarantine)
        finally:
            v.unpersist()

    return (s.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).queryName("stream_score").start())


def _features_of(batch: DataFrame, features: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """The batch with its orders' features. Up to ``rows`` keys (counted) are sent
    to the feature table's scan, which then neither shuffles nor sorts as a whole."""
    keys = batch.select("order_id").distinct()
    keys = F.broadcast(keys) if keys.count() <= rows else keys
    return batch.join(features.join(keys, "order_id", "left_semi"), "order_id", "left")


def stream_score_model(src: DataFrame, features: DataFrame, allowed: DataFrame, store: str,
                       out: str, quarantine: str, checkpoint: str, watermark: str = "1 day",
                       version: int | None = None) -> StreamingQuery:
    """:func:`stream_score` with a fitted model from the store (``models.publish``).

    Every micro-batch scores with one version: the stated one, or the newest
    when the batch first ran. The choice is written before the scores, so a
    replayed batch takes the same model and writes the same rows, whatever has
    been published since. Features are looked up for the batch's orders only.
    """
    spark = src.sparkSession
    s = (src.withWatermark(EVENT_TS, watermark).where(rows_only())
         .dropDuplicatesWithinWatermark(["order_id"]))

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            use = mdl.pinned_version(spark, store, f"{out}-versions", batch_id, version)
            v = val.validate_rows(_features_of(batch, features), allowed).persist()
            try:
                good = mdl.score(mdl.load_version(spark, store, use), v.where("is_valid = 1")).select(
                    "order_id", EVENT_TS, "y_proba", "y_pred", F.lit(use).alias("model_version"))
                bad = v.where("is_valid = 0").select(
                    "order_id", EVENT_TS, val.canonical_errors("errors").alias("errors"))
                _write_batch(good, batch_id, out)
                _write_batch(bad, batch_id, quarantine)
            finally:
                v.unpersist()
        finally:
            batch.unpersist()

    return (s.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).queryName("stream_score_model").start())


# --- ST2: tumbling-window statistics ----------------------------------------

def stream_window_stats(src: DataFrame, out: str, checkpoint: str, window: str = "1 day",
                        watermark: str = "1 day", by: list[str] | None = None) -> StreamingQuery:
    """Per (window, by...) count / mean / min / max of ``value``; update
    mode, each micro-batch's changed windows logged by batch id."""
    by = by or ["event_type"]
    agg = (src.withWatermark(EVENT_TS, watermark)
           .groupBy(F.window(EVENT_TS, window).alias("w"), *by)
           .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"),
                F.min("value").alias("min_value"), F.max("value").alias("max_value"))
           .select(F.col("w.start").alias("window_start"), *by, "n", "mean_value",
                   "min_value", "max_value"))
    return (agg.writeStream.outputMode("update")
            .foreachBatch(lambda b, i: _write_batch(b, i, out))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .queryName("stream_window_stats").start())


def stream_windows_final(src: DataFrame, out: str, checkpoint: str, window: str = "1 day",
                         watermark: str = "1 day", by: list[str] | None = None,
                         name: str = "stream_windows_final") -> StreamingQuery:
    """:func:`stream_window_stats` in append mode: a window is written once, when
    the watermark has passed its end. Rows later than the watermark, and repeated
    deliveries of an order within it, are dropped before the aggregation, so the
    dropped rows of the progress reports (:class:`ProgressLog`) are single rows."""
    by = by or ["event_type"]
    s = (src.withWatermark(EVENT_TS, watermark).where(rows_only())
         .dropDuplicatesWithinWatermark(["order_id"]))
    agg = (s.groupBy(F.window(EVENT_TS, window).alias("w"), *by)
           .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"),
                F.min("value").alias("min_value"), F.max("value").alias("max_value"))
           .select(F.col("w.start").alias("window_start"), *by, "n", "mean_value", "min_value", "max_value"))
    return (agg.writeStream.format("parquet").option("path", out).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(name).start())


# --- ST3: drift counts against fixed reference edges --------------------------

def stream_drift(src: DataFrame, edges: DataFrame, out: str, checkpoint: str,
                 feature: str = "value", window: str = "1 day",
                 watermark: str = "1 day") -> StreamingQuery:
    """Bin counts per (window, bin) on the reference's inner edges
    (stream-static join with the one-row-per-feature edge table)."""
    e = edges.where(F.col("feature") == feature).select("feature", "edges")
    binned = (src.withWatermark(EVENT_TS, watermark)
              .where(F.col(feature).isNotNull())
              .withColumn("feature", F.lit(feature))
              .join(e, "feature", "inner")
              .withColumn("bin", bin_index(F.col(feature).cast("double"), "edges")))
    counts = (binned.groupBy(F.window(EVENT_TS, window).alias("w"), "bin")
              .agg(F.count(F.lit(1)).alias("n"))
              .select(F.col("w.start").alias("window_start"), "bin", "n"))
    return (counts.writeStream.outputMode("update")
            .foreachBatch(lambda b, i: _write_batch(b, i, out))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .queryName("stream_drift").start())


def psi_from_counts(counts: DataFrame, ref_shares: DataFrame, n_bins: int = 10,
                    eps: float = 1e-4) -> DataFrame:
    """PSI per window from final (window_start, bin, n) counts (tiny table)."""
    from pyspark.sql import Window
    wins = counts.select("window_start").distinct()
    scaffold = wins.select("window_start", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)))
                           .alias("bin"))
    c = (scaffold.join(counts, ["window_start", "bin"], "left")
         .withColumn("n", F.coalesce("n", F.lit(0)))
         .withColumn("c", F.col("n") / F.sum("n").over(Window.partitionBy("window_start"))
                     + F.lit(eps)))
    j = c.join(ref_shares, "bin", "left") \
        .withColumn("r", F.coalesce("r_share", F.lit(0.0)) + F.lit(eps))
    return j.groupBy("window_start").agg(
        F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))).alias("psi"))


DRIFT_SCHEMA = "window_start timestamp, feature string, n bigint, psi double, red_run int"
RUN_SCHEMA = "feature string, window_start timestamp, red_run int"


def _window_psi(counts: DataFrame, reference: DataFrame, eps: float) -> DataFrame:
    """PSI per (window_start, feature) from counts (window_start, feature, bin, n)."""
    by_bin = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    got = counts.groupBy("window_start", "feature").agg(by_bin.alias("bins"), F.sum("n").alias("n"))
    share = F.transform("shares", lambda _, i: F.coalesce(F.try_element_at("bins", i), F.lit(0)) / F.col("n") + eps)
    parts = F.zip_with(share, "shares", lambda c, r: (c - r - eps) * F.ln(c / (r + eps)))
    return got.join(reference, "feature").select(
        "window_start", "feature", "n", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("psi"))


def _red_runs(judged: DataFrame, before: DataFrame, window: str) -> DataFrame:
    """``judged`` with ``red_run``: RED windows in a row up to each one, going on
    from the last window of ``before`` (feature, window_start, red_run)."""
    rows = judged.withColumn("red", F.col("psi") >= PSI_RED).withColumn("add", F.lit(1)).unionByName(before.select(
        "feature", "window_start", (F.col("red_run") > 0).alias("red"), F.col("red_run").alias("add")),
        allowMissingColumns=True)
    order = Window.partitionBy("feature").orderBy("window_start")  # the windows of a micro-batch
    gap = F.col("window_start") - F.expr(f"INTERVAL {window}") != F.lag("window_start").over(order)
    new = F.coalesce(gap, F.lit(True)) | ~F.col("red") | ~F.coalesce(F.lag("red").over(order), F.lit(False))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(order))
    run = F.when(F.col("red"), F.sum("add").over(Window.partitionBy("feature", "run").orderBy("window_start"))).otherwise(0)
    return rows.withColumn("red_run", run.cast("int"))


def stream_psi(src: DataFrame, reference: DataFrame, out: str, checkpoint: str,
               feature: str = "feature", value: str = "value", window: str = "1 day",
               watermark: str = "1 day", eps: float = 1e-4, keep: str = "7 days",
               name: str = "stream_psi") -> StreamingQuery:
    """PSI and the run of RED windows per feature, judged micro-batch by micro-batch.

    ``reference`` (feature, edges, shares): one row per feature, inner edges and
    the shares of its bins. The counts of window, feature and bin are the stream's
    state; a final window's few counts become its PSI, and the run of RED windows
    goes on from the state table, one row per feature: every micro-batch reads
    that of the one before and writes its own, so a replay gives the same rows. A
    window without a value gives no row and ends the run. A feature that has no
    window for ``keep`` leaves the table.
    """
    spark = src.sparkSession
    counts = (src.withWatermark(EVENT_TS, watermark)
              .withColumn("feature", F.coalesce(F.col(feature), F.lit("")))
              .where(rows_only() & (F.col(value).isNotNull() & ~F.isnan(value) | F.col(EVENT_TS).isNull()))
              .join(F.broadcast(reference.select("feature", "edges")), "feature")
              .withColumn("bin", bin_index(F.col(value).cast("double"), "edges"))
              .groupBy(F.window(EVENT_TS, window).alias("w"), "feature", "bin")
              .agg(F.count(F.lit(1)).alias("n"))
              .select(F.col("w.start").alias("window_start"), "feature", "bin", "n"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        state = mdl.stored_rows(spark, f"{out}-state", f"{RUN_SCHEMA}, batch_id bigint")
        before = state.where(F.col("batch_id") == batch_id - 1).drop("batch_id")
        rows = _red_runs(_window_psi(batch, reference, eps), before, window).persist()
        try:
            judged = rows.where("psi is not null")
            _write_batch(judged.select("window_start", "feature", "n", "psi", "red_run"), batch_id, out)
            last = rows.groupBy("feature").agg(F.max_by(F.struct("window_start", "red_run"), "window_start").alias("v"))
            newest = rows.agg(F.max("window_start")).scalar()
            held = last.select("feature", "v.*").where(F.col("window_start") >= newest - F.expr(f"INTERVAL {keep}"))
            _write_batch(held, batch_id, f"{out}-state")
        finally:
            rows.unpersist()

    return (counts.writeStream.outputMode("append").foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(name).start())


# --- ST4: deduplication -------------------------------------------------------

def stream_dedup(src: DataFrame, out: str, checkpoint: str, key: str = "order_id",
                 watermark: str = "1 day") -> StreamingQuery:
    """Drop repeated deliveries of a key within the watermark; file sink."""
    d = src.withWatermark(EVENT_TS, watermark).dropDuplicatesWithinWatermark([key])
    return (d.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).queryName("stream_dedup").start())


# --- ST5: delayed labels --------------------------------------------------------

def stream_label_join(predictions: DataFrame, labels: DataFrame, out: str, checkpoint: str,
                      max_delay: str = "4 days", watermark: str = "6 days",
                      how: str = "inner", name: str = "stream_label_join") -> StreamingQuery:
    """Stream-stream join (``how`` inner or leftOuter) of predictions (order_id, scored_ts, y_proba,
    y_pred) with reviews arriving later (order_id, review_ts, review_score):
    ``review_ts`` between ``scored_ts`` and ``scored_ts + max_delay``.

    The watermark must exceed the longest label delay, or labels that
    arrive after newer ones are dropped as late; join state then holds that
    many days of predictions (RocksDB state store, see session.py).

    ``leftOuter`` also writes the predictions whose label never came, with null
    label columns, once the watermark has passed the last moment at which one
    could have been matched; their state ends there. Rows without an order id
    (a feed's closing row) only move the watermark."""
    p = predictions.withWatermark("scored_ts", watermark).where(rows_only("scored_ts")).alias("p")
    lab = labels.withWatermark("review_ts", watermark).where(rows_only("review_ts")).alias("l")
    # null keys never meet; a plain equality would filter them before the watermark, see rows_only
    cond = F.expr(f"""coalesce(p.order_id, -1) = coalesce(l.order_id, -2) AND l.review_ts >= p.scored_ts
                      AND l.review_ts <= p.scored_ts + INTERVAL {max_delay}""")
    j = p.join(lab, cond, how).select(
        F.col("p.order_id").alias("order_id"), "scored_ts", "review_ts", "y_proba", "y_pred",
        "review_id", "review_score",
        F.expr("CAST(review_score >= 4 AS INT)").alias("y_true"))
    return (j.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).queryName(name).start())
