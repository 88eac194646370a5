"""Test feed: a table landed as arriving files, in ranges of a key."""

from pyspark.sql import functions as F


def land_events(events, path, n_ranges=8, files=1, duplicate_last=False):
    ev = events.select(F.col("event_id").alias("order_id"), F.col("ts").cast("timestamp").alias("event_ts"),
                       "event_type", "value", "user_id")
    lo, hi = ev.agg(F.min("order_id"), F.max("order_id")).first()
    width = (hi - lo + n_ranges) // n_ranges
    starts = [lo + i * width for i in range(n_ranges)]
    for start in starts + starts[-1:] * duplicate_last:
        part = ev.where((F.col("order_id") >= start) & (F.col("order_id") < start + width))
        part.repartitionByRange(files, "order_id").write.mode("append").parquet(path)
