"""Shared helpers: staged tables in the shared folder, Arrow text slices, word hashes.

A word is a maximal run of characters other than blank and 0x09-0x0D. These
separators are single ASCII bytes, so words are cut on the UTF-8 bytes of a
whole Arrow slice at once.
"""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.session import ensure_checkpoint_dir

SLICE_BYTES = 1 << 18  # text bytes handled by one vectorised step (one text at least)

#: Rows and bytes of a batch between Spark and a Python worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}

_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


_HELD: dict[str, dict] = {}
_SHIPPED: set[str] = set()


def held(owner: str) -> dict:
    """What a Python worker keeps for one operator between tasks. Workers serve one
    operator after the other: the tables of the others are released."""
    if owner not in _HELD:
        _HELD.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _HELD[owner] = {}
    return _HELD[owner]


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once per application
    (nothing to do when it was submitted as an archive)."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if sc.applicationId not in _SHIPPED and root.is_dir():
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='orderpulse-')}/orderpulse", "zip", root, "orderpulse")
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)
    for key, value in BATCHES.items():  # whole texts go through the workers: small batches, unless the user chose
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the cluster's checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")  # shuffle files of this write go when it is done
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A staged join side, broadcast when its counted rows (of a few numbers each)
    stay within ``rows``; beyond that the planner joins it by shuffling."""
    return F.broadcast(df) if df.count() <= rows else df


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that a piece holds about ``size`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_buffer(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offs, offs[lo] + size, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (rows + 1) of a string column; null counts as empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        have = np.full(size, base & (2**64 - 1), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POW[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words of a slice of texts: byte spans, 64-bit hashes, first word of each text."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = False):
        if lower:
            raw = _LOWER[raw]
        self.raw, self.offs = raw, offs
        n = len(raw)
        solid = ~_WS[raw]
        self.solid = solid
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        first = solid.copy()
        last = solid.copy()
        if n:
            first[1:] &= ~solid[:-1] | edge[1:-1]
            last[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        pref = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _powers(_BASE, n), out=pref[1:])
        self._pref = pref
        self.hash = self.span_hash(self.starts, self.ends)
        self.row0 = np.searchsorted(self.starts, offs)  # index of the first word of each text
        self.n_words = np.diff(self.row0)

    def span_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the bytes [lo, hi): a polynomial in random byte values."""
        return mix((self._pref[hi] - self._pref[lo]) * _powers(_INV, len(self.raw) + 1)[lo])

    def grams(self, size: int, seed: int = 0x2545F4914F6CDD1D) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the ``size`` words from each word on; valid: all in one text."""
        h = window_hash(self.hash, size, seed)
        left = np.repeat(self.row0[1:], self.n_words) - np.arange(len(self.hash))
        return h, left >= size


def window_hash(word: np.ndarray, size: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Polynomial hash of ``size`` consecutive values by doubling; tails wrap and are invalid."""
    n = len(word)
    if not n:
        return word.copy()
    acc, have, power = None, 0, word.copy()
    span, m = 1, seed | 1
    mult = m
    while True:
        if size & span:
            acc = power.copy() if acc is None else np.roll(power, -have) + acc * np.uint64(mult)
            have += span
        if span * 2 > size:
            break
        power = power * np.uint64(mult) + np.roll(power, -span)
        mult = mult * mult & (2**64 - 1)
        span *= 2
    return mix(acc)
