"""URL filter: exact list membership by a cascade of Bloom filters.

The corpus states its complete key universe: every host suffix of every url, with
every path prefix of a length that the list uses. Level 1 of a cascade encodes the
listed keys. The unlisted keys of the universe that pass it (its false positives)
are encoded by level 2, the listed keys that pass level 2 by level 3, and so on
until no key is left. The first level that a key of the universe does not pass
tells whether it is listed, without an error and without a join: pages are judged
in one pass with the filters at hand.

The first level passes about 0.7 unlisted keys per listed one, the others half of
what they see, so a cascade takes a few bits per listed key however large the
universe is. Its size is counted before it is built. Beyond ``max_bytes`` the keys
are dealt by hash to several cascades, and each pass over the pages holds as many
as fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import mix, ship, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)"


class Level(NamedTuple):
    """One Bloom filter: ``hashes`` bits per key in ``words`` of 64 bits."""

    seed: int
    hashes: int
    words: np.ndarray

    def bits(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return _bits(h1, h2, self.seed, self.hashes, 64 * len(self.words))

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.bits(h1, h2)
        hit = self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
        return hit.all(axis=0)


def _bits(h1: np.ndarray, h2: np.ndarray, seed: int, hashes: int, size: int) -> np.ndarray:
    """(hashes, keys) bit positions; other ones at each level."""
    salt = np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    a, b = mix(h1 ^ salt), mix(h2 + salt) | np.uint64(1)
    return (a + np.arange(hashes, dtype=np.uint64)[:, None] * b) % np.uint64(size)


class Cascade(NamedTuple):
    """Exact membership of the keys whose hash falls to ``shard`` of ``shards``."""

    kind: str
    shard: int
    shards: int
    levels: tuple[Level, ...]

    @property
    def nbytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        left = np.flatnonzero(_shard(h2, self.shards) == self.shard)
        for i, level in enumerate(self.levels):
            ok = level.passes(h1[left], h2[left])
            found[left[~ok]] = i % 2 == 1  # stopped by a level of false positives: listed
            left = left[ok]
        found[left] = len(self.levels) % 2 == 1
        return found


def _shard(h2: np.ndarray, shards: int) -> np.ndarray:
    return (mix(h2) % np.uint64(shards)).astype(np.int64)


def hashes(key: Column) -> tuple[Column, Column]:
    """128 bits of a key, as two longs."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _hashed(keys: DataFrame) -> DataFrame:
    h1, h2 = hashes(F.col("key"))
    return keys.select(h1.alias("h1"), h2.alias("h2")).distinct()


def _pick(keys: DataFrame, test) -> DataFrame:
    """Rows (h1, h2) for which ``test`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (c.to_numpy().view(np.uint64) for c in b.columns)
            yield b.filter(pa.array(test(h1, h2)))

    return keys.mapInArrow(run, "h1 long, h2 long")


def _encode(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """Bloom filter of ``n`` keys with false-positive rate ``rate``, built in the
    tasks as 64-bit words that are merged by their positions."""
    k = max(1, round(math.log2(1 / rate)))
    size = 64 * math.ceil(n * math.log2(1 / rate) / math.log(2) / 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (c.to_numpy().view(np.uint64) for c in b.columns)
            at = np.unique(_bits(h1, h2, seed, k, size))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                bit = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(bit.view(np.int64))], ["word", "bits"])

    got = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Level(seed, k, words)


def build(kind: str, listed: DataFrame, universe: DataFrame, max_bytes: int = 16 << 20) -> list[Cascade]:
    """Cascades for the keys ``listed`` within ``universe`` (both: h1, h2; distinct rows).

    Listed keys that the universe lacks are encoded too and cost nothing else. An
    empty list gives no cascade.
    """
    listed = stage(listed, "listed-keys")
    n, u = listed.count(), universe.count()
    if not n:
        return []
    rate = min(0.5, n * math.sqrt(0.5) / max(u, 1))
    shards = math.ceil(n * (1.45 * math.log2(1 / rate) + 5) / 8 / max_bytes)
    out = []
    for s in range(shards):
        mine = lambda h1, h2, s=s: _shard(h2, shards) == s
        inside = stage(_pick(listed, mine), "shard-keys") if shards > 1 else listed
        count = inside.count() if shards > 1 else n
        if not count:
            continue
        levels = [_encode(inside, count, rate, 0)]
        first = levels[0]
        passed = stage(_pick(universe, lambda h1, h2: mine(h1, h2) & first.passes(h1, h2)), "passed")
        other = stage(passed.join(inside, ["h1", "h2"], "left_semi"), "listed-passed")
        wrong = stage(passed.join(inside, ["h1", "h2"], "left_anti"), "false-positives")
        while left := wrong.count():
            level = _encode(wrong, left, 0.5, len(levels))
            levels.append(level)
            wrong, other = stage(_pick(other, level.passes), "false-positives"), wrong
        out.append(Cascade(kind, s, shards, tuple(levels)))
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _PARTS, 1), UPPER, LOWER), F.regexp_extract(text, _PARTS, 2)


def candidates(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """Every host suffix of so many labels with every path prefix of the stated lengths, the longest key first."""
    labels = F.split(host, r"\.")
    tails = F.filter(F.array(*[F.when(F.size(labels) >= d, F.array_join(F.slice(labels, -d, d), "."))
                               for d in depths]), lambda x: x.isNotNull() & (x != ""))
    heads = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]),
                     lambda x: x.isNotNull())
    keys = F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda p: F.struct(
        (-F.length(t) - F.length(p)).alias("rank"), (-F.length(t)).alias("tail"), F.concat(t, p).alias("key")))))
    return F.transform(F.array_sort(keys), lambda x: x["key"])


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    ``rules`` (key, verdict): a key is a host followed by the beginning of a path
    ("example.net/en/"); it fits its host and all subdomains when the path starts
    with the rest. The longest fitting rule gives the verdict, of equally long ones
    that with the longer host. ``listed`` (key): hosts, blocked with all their
    subdomains where no rule fits. Everything else is allowed. Lists are tables of
    any size; keys are taken as they stand (hosts in lower case), null and repeated
    ones do not count; a key that is both blocked and allowed is blocked.

    A null url, or one without "://", has an empty host and path, fits no rule and
    is allowed. Repeated and very long urls, null ids: judged like any other. An
    empty table gives an empty table; further columns are ignored. Keys are told
    apart by 128-bit hashes.
    """
    spark = pages.sparkSession
    ship(spark)
    keyed = rules.where("key is not null").select("key", F.instr("key", "/").alias("at"), "verdict").select(
        "key", "verdict", F.when(F.col("at") > 0, F.expr("left(key, at - 1)")).otherwise(F.col("key")).alias("host"))
    hosts = listed.where("key is not null")
    # how the lists' keys are cut: a few numbers, at most the longest path and host of a list
    cuts = keyed.select(F.lit("path").alias("of"), (F.length("key") - F.length("host")).alias("n")).union(
        keyed.select("host").union(hosts.select("key")).select(F.lit("host"), F.size(F.split("host", r"\."))))
    cuts = [tuple(r) for r in cuts.distinct().collect()]
    lengths, depths = (sorted({n for of, n in cuts if of == x}) for x in ("path", "host"))
    host, path = parts(F.col("url"))
    found = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = candidates(F.col("host"), F.col("path"), depths or [1], sorted({0, *lengths}))
    universe = stage(_hashed(found.select("host", "path").distinct().select(F.explode(seen).alias("key"))), "url-keys")
    block, allow = (_hashed(keyed.where(F.col("verdict") == x)) for x in ("block", "allow"))
    every = [c for kind, keys in (("block", block), ("allow", allow), ("listed", _hashed(hosts)))
             for c in build(kind, keys, universe, max_bytes)]
    work = found.withColumn("keys", seen).select(
        "*", F.transform("keys", lambda k: hashes(k)[0]).alias("h1"),
        F.transform("keys", lambda k: hashes(k)[1]).alias("h2"),
        F.lit(None).cast("int").alias("block"), F.lit(None).cast("int").alias("allow"),
        F.lit(None).cast("int").alias("listed"))
    while every:  # one pass unless the cascades exceed max_bytes
        now = [every.pop(0)]
        while every and sum(c.nbytes for c in now) + every[0].nbytes <= max_bytes:
            now.append(every.pop(0))
        work = _lookup(work, now)
        if every:
            work = stage(work, "judged")
    best = F.least("block", "allow")
    return work.select(
        "page_id", "host", "path", F.get("keys", best).alias("rule"),
        F.when(best.isNotNull(), F.when(F.col("block") <= F.coalesce("allow", "block"), "block").otherwise("allow"))
        .otherwise(F.when(F.col("listed").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def _lookup(work: DataFrame, cascades: list[Cascade]) -> DataFrame:
    """The least index of a listed key, by kind, with what earlier passes found."""
    held = work.sparkSession.sparkContext.broadcast(cascades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            keys = b.column(at["h1"])
            size = keys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h1 = keys.flatten().to_numpy().view(np.uint64)
            h2 = b.column(at["h2"]).flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(b.num_rows), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            cols = list(b.columns)
            for kind in ("block", "allow", "listed"):
                first = cols[at[kind]].fill_null(2**31 - 1).to_numpy().copy()
                for c in held.value:
                    if c.kind == kind:
                        hit = c.member(h1, h2)
                        np.minimum.at(first, row[hit], place[hit].astype(np.int32))
                cols[at[kind]] = pa.array(first, mask=first == 2**31 - 1)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return work.mapInArrow(run, work.schema)
