"""Target-distribution importance resampling on hashed word n-grams.

A batch of texts is joined with separators, one regex pass finds all of its words,
and the texts' offsets tell by binary search which text a word belongs to; an
n-gram whose first and last word belong to two texts is masked. The features'
buckets are counted per batch (``bincount``) and summed over the table.

The first pass counts the buckets of the raw and of the target texts, the second
weighs every document by its features' gains. The draw is by weight plus Gumbel
noise from a hash of the id (the largest scores are a sample without replacement,
in proportion to the weights), ranked by range partitions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import ship, slices, stage, text_buffer
from orderpulse.llm.terms import encode

SEPARATOR = b"\x00"
_GAP_AND_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]*+[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SOLID = np.zeros(256, bool)
_SOLID[0x30:0x3A] = _SOLID[0x61:0x7B] = _SOLID[0x80:] = True
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


class Batch:
    """Words of a batch of texts: ``words`` in order, ``doc`` of each, ``n_docs``."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        data = raw.tobytes().translate(_LOWER)
        ends = offs.tolist()
        # a last word of our own: every gap is followed by a word, so the pass never goes back
        joined = SEPARATOR.join([*[data[a:b] for a, b in zip(ends[:-1], ends[1:])], b"a"])
        begin = offs[:-1] + np.arange(len(offs) - 1)  # of each text in ``joined``
        found = np.fromiter(map(len, _GAP_AND_WORD.findall(joined)), np.int64)
        stop = np.cumsum(found)[:-1]
        self.n_docs = len(begin)
        self.doc = np.searchsorted(begin, stop - 1, "right") - 1
        letters = np.frombuffer(joined, np.uint8)
        solid = _SOLID[letters]
        at = np.append(0, np.cumsum(solid)[stop - 1]).astype(np.int64)
        self.words = pa.LargeStringArray.from_buffers(
            len(stop), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(letters[solid])))

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)

    def features(self, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(doc, bucket) of all runs of 1, 2 ... ``most`` words."""
        code, names = encode(self.words)
        names = [x.encode() for x in names.to_pylist()]
        run, texts = code, names  # code of the run that starts at each word, and the distinct runs
        for n in range(1, most + 1):
            if n > 1:
                last = np.arange(n - 1, len(code))
                inside = self.doc[last - n + 1] == self.doc[last]
                # a run of n words is a run of n - 1 and one more word
                key = run[:max(len(code) - n + 1, 0)] * len(names) + code[last]
                distinct, run = np.unique(key, return_inverse=True)
                texts = [texts[x // len(names)] + b" " + names[x % len(names)] for x in distinct.tolist()]
            else:
                inside = np.ones(len(code), bool)
            bucket = np.fromiter((zlib.crc32(x) % buckets for x in texts), np.int64, len(texts))
            yield self.doc[:len(run)][inside], bucket[run][inside]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    for b in slices(batches, size=1 << 20):
        yield b, Batch(*text_buffer(b.column(b.schema.get_field_index("text"))))


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """Features of all ``texts`` (text) by bucket; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, batch in _batches(batches):
            for _, bucket in batch.features(most, buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    got = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in got.collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and raw texts."""
    top = (target + 1).astype(float) * float(raw.sum() + len(raw))
    below = (raw + 1).astype(float) * float(target.sum() + len(raw))
    return np.floor(1000 * np.log(top / below)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) per row of ``docs`` (doc_id, text)."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, batch in _batches(batches):
            count, weight = np.zeros(batch.n_docs, np.int64), np.zeros(batch.n_docs, np.int64)
            for doc, bucket in batch.features(most, buckets):
                count += np.bincount(doc, minlength=batch.n_docs)
                np.add.at(weight, doc, gain[bucket])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(batch.per_doc()), pa.array(count), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Thousandths of a Gumbel draw, from a hash of the seed and the document's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the stated order: range partitions are sorted and
    numbered each, their sizes (one number per partition) added."""
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            at = np.arange(done + 1, done + b.num_rows + 1)
            done += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(at)], [*names, "part", "at"])

    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = stage(dealt.mapInArrow(number, schema + ", part int, at long"), "ranked")
    size = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.max("at").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(size):
        before[part], total = total, total + size[part]
    if not size:
        return placed.select(*names, F.col("at").alias("rank"))
    starts = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v).cast("long")) for k, v in before.items()))
    return placed.select(*names, (F.col("at") + F.get(F.map_values(starts), F.array_position(
        F.map_keys(starts), F.col("part")).cast("int") - 1)).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = 10_000, min_words: int = 20,
             percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased;
    features are all runs of 1 to ``most`` words of a text, repeats counted, hashed
    (crc32) to ``buckets``. ``weight`` sums the features' gains of ``target`` (text)
    over ``docs``. Of the rows with ``min_words`` words the ``percent`` in a hundred
    with the highest score are drawn and ranked; the rank of others is null.

    A null text is empty: no feature, weight 0, never drawn unless ``min_words`` is 0.
    Texts count whole. Equal scores go by doc_id; rows that repeat an id are rows of
    their own, and a null id comes last among ties. An empty table gives an empty
    table, an empty target gains by the smoothing alone; further columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    scored = stage(weigh(docs, gain, most).withColumn("score", F.col("weight") + noise(seed)), "scored")
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("weight")]
    out = ranked(fit, order, parts).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(
        scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
