"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orderpulse.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [" ".join(w[i:i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, most, buckets, min_words, percent, seed=2024):
    at = lambda x: zlib.crc32(x.encode()) % buckets
    raw = Counter(at(x) for _, t in rows for x in features(t, most)[1])
    aim = Counter(at(x) for t in target for x in features(t, most)[1])
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
            for b in range(buckets)]
    out = []
    for d, t in rows:
        n, f = features(t, most)
        w = sum(gain[at(x)] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2]))
    for i, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)] + ["Été", "中文", "A1", "x-y", "_", "don't"]
    text = lambda k: rng.choice([" ", "\n", "\x00 "]).join(rng.choice(vocab) for _ in range(k))
    rows = [(i, text(rng.randint(0, 60))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "  ..  "), (None, text(40)), (n + 3, "word " * 60_000 + "  " * 50_000),
             (n + 4, "z" * 200_000), rows[7], rows[7], (n + 5, rows[8][1])]
    return rows, [text(30) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("most,buckets,percent", [(1, 10_000, 10), (2, 97, 50), (3, 1000, 100)])
def test_equals_plain_version(spark, most, buckets, percent):
    rows, target = corpus()
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows],
                                 "doc_id long, text string, weight int, part int, score string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = I.resample(docs, aim, most, buckets, 20, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, target, most, buckets, 20, percent)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert I.resample(none, none.select("text")).collect() == []
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert I.resample(one, none.select("text"), percent=100).first()["rank"] == 1


def test_separator_in_a_text_joins_nothing():
    texts = [b"a\x00b", b"", b"\x00", b"c d"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    batch = I.Batch(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert batch.words.to_pylist() == ["a", "b", "c", "d"] and batch.doc.tolist() == [0, 0, 3, 3]
    assert [len(d) for d, _ in batch.features(2, 10)] == [4, 2]


def test_ranks_follow_the_order_over_partitions(spark):
    rows = [(i, (i * 7919) % 50) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, score long").repartition(6)
    from pyspark.sql import functions as F
    got = {r["doc_id"]: r["rank"] for r in I.ranked(df, [F.desc("score"), F.asc("doc_id")], 7).collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {d: i + 1 for i, (d, _) in enumerate(want)}
