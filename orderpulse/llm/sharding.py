"""Sharding by sampled splitters.

Keys are (hash of the text, id), so equal texts are neighbours. A size-weighted
sample of the keys, bounded by ``sample``, gives quantile splitters, which cut
the keys into ``ranges`` fine ranges. Exact bytes and rows per range follow from
one partial aggregate, and a running sum over the small range table tells where
each range starts. Shard borders lie at equal steps of the total bytes; a range
over a border is overfull and is subdivided where the border falls, by the
running sum inside it. A range never crosses a task border, and a group of equal
texts larger than a range is split by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import stage

LAW = "bytes"


def splitters(keys: DataFrame, ranges: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantile keys (hash, id) of a size-weighted sample of about ``sample`` rows."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    unit = F.xxhash64("doc_id", "h", F.lit(17)) / F.lit(2.0**64) + 0.5
    picked = keys.where(unit < F.col("size") * (sample / max(total, 1))).select(
        "h", "doc_id", F.greatest(F.lit(1.0), F.col("size") * (sample / max(total, 1))).alias("w"))
    rows = sorted(tuple(r) for r in picked.collect())
    weight = np.cumsum([w for _, _, w in rows])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.unique(np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges).clip(0, len(rows) - 1))
    pairs = sorted({(rows[i][0], rows[i][1]) for i in at})
    return np.array([h for h, _ in pairs], np.int64), np.array([d for _, d in pairs], np.int64)


def range_of(h: np.ndarray, d: np.ndarray, sh: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Number of splitters at or below each key."""
    lo, hi = np.searchsorted(sh, h, "left"), np.searchsorted(sh, h, "right")
    out = lo.copy()
    for i in np.flatnonzero(hi > lo):  # only keys that share their hash with a splitter
        out[i] += np.searchsorted(sd[lo[i]:hi[i]], d[i], "right")
    return out


def shard(docs: DataFrame, shards: int = 16, ranges: int = 1024, sample: int = 16_384) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) per row.

    Size is the UTF-8 bytes of the text plus 1; a null text counts as empty.
    Repeated rows are placed each, and null ids rank last. Shards hold equal
    bytes up to one row. Slots number a shard's rows from 0 in key order. An
    empty table gives an empty table; extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = 2**63 - 1
    keys = stage(docs.select(
        F.coalesce(F.col("doc_id"), F.lit(none)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")), "shard-keys")
    sh, sd = splitters(keys, ranges, sample)

    @F.pandas_udf("int")
    def rng(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(range_of(h.to_numpy(), d.to_numpy(), sh, sd).astype(np.int32))

    keyed = keys.withColumn("range", rng("h", "doc_id"))
    tally = keyed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))

    def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames), ignore_index=True).sort_values("range")
        f["start"] = f["bytes"].cumsum() - f["bytes"]
        f["total"] = f["bytes"].sum()
        yield f[["range", "start", "total"]]

    # at most ``ranges`` rows: their running sum is taken in one task
    begin = stage(tally.coalesce(1).mapInPandas(starts, "range int, start long, total long"), "range-starts")
    inside = Window.partitionBy("range").orderBy("h", "doc_id", "no_id")
    placed = keyed.join(begin, "range").select(
        "*", (F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))).alias("b"))
    before = F.coalesce(F.col("b"), F.col("start"))
    middle = before * 2 + F.col("size")  # twice the middle of the row's bytes
    placed = stage(placed.withColumn(
        "shard", F.least(F.lit(shards - 1), F.floor(
            middle.cast("decimal(28,0)") * shards / (F.col("total") * 2))).cast("int")), "placed")
    runs = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("rows"))
    first = runs.select("shard", "range", F.coalesce(F.sum("rows").over(
        Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "range").orderBy("h", "doc_id", "no_id")
    return placed.join(first, ["shard", "range"]).select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "size", "text_crc32",
        F.lit(LAW).alias("law"), "shard",
        (F.col("first") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
