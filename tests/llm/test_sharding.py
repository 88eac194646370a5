"""Sampled splitters: every row once, equal bytes, gapless slots, equal texts together."""

import zlib
from collections import Counter, defaultdict

from orderpulse.llm import sharding as S


def test_shards_hold_equal_bytes_and_gapless_slots(spark):
    rows = [(i, "x" * (i * 37 % 200)) for i in range(3000)] + [(i + 5000, "hot copy") for i in range(1500)]
    rows += [(1, "x" * 37), (None, "é"), (None, None), (7000, None)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, shard int")
    got = [r.asDict() for r in S.shard(df.repartition(6), ranges=200, sample=2000).collect()]
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(load) == list(range(16))
    assert max(load.values()) - min(load.values()) <= 2 * max(size(t) for _, t in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = {r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"hot copy")}
    assert max(hot) - min(hot) == len(hot) - 1


def test_empty_table(spark):
    assert S.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
