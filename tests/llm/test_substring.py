"""Substring dedup against a brute-force version."""

import hashlib
import random
import re

import pytest

from orderpulse.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    """rows: (doc_id, text) -> (doc_id, n_words, n_removed, sha) with the windows judged on the input."""
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - size + 1):
            k, at = tuple(w[i:i + size]), (d, i)
            if k not in first or at < first[k]:
                first[k] = at
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < (d, i):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "中", "x y"]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([15, 20, 21, 33, 80]))] for _ in range(8)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
            w += rng.choice(passages)
        if d % 9 == 0:
            w += ["same"] * rng.randint(10, 70)
        rows.append((d * 7 % n, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(1000 + i, rows[3][1]) for i in range(5)]  # copies
    rows += [(rows[5][0], rows[5][1]), (2000, ""), (2001, None), (2002, " \n"), (2003, "short text")]
    return rows


@pytest.mark.parametrize("seed,size", [(1, 20), (2, 20), (3, 50)])
def test_digest_equals_brute_force(spark, seed, size):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string")
    got = sorted(tuple(r) for r in S.kept_digest(df.repartition(5), size).collect())
    assert got == brute(rows, size)


def test_dedup_keeps_columns_and_drops_emptied_rows(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, p, 5, "a"), (2, p, 5, "b"), (3, f"intro {p} tail", 5, None), (4, None, None, "c"), (5, "", 0, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, pos string")
    got = {r["doc_id"]: r for r in S.dedup(df).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[3]["text"] == "intro tail" and got[3]["n_chars"] == 10 and got[3]["pos"] is None
    assert got[4]["text"] is None and got[1]["text"] == p


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.kept_digest(df).collect() == []
    p = " ".join(f"p{i}" for i in range(30))
    df = spark.createDataFrame([(None, p), (7, p)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in S.kept_digest(df).collect()}
    assert got == {7: 0, None: 30}
