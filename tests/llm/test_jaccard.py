"""Jaccard join and components against brute force."""

import random
import re

import pytest

from orderpulse.llm import jaccard_join as J
from orderpulse.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORD.findall(t)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, n, group):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, base = [], [[rng.choice(vocab) for _ in range(rng.choice([4, 12, 30, 60, 150]))] for _ in range(12)]
    for d in range(n):
        w = list(base[0] if d < group else rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            i = rng.randrange(len(w)) if w else 0
            w[i:i + 1] = rng.choice([[], [rng.choice(vocab).upper()], w[i:i + 1] + [rng.choice(vocab)]])
        rows.append((d * 13 % n, " ".join(w)))
    return rows + [(n, ""), (n + 1, None), (n + 2, rows[0][1].upper()), (rows[4][0], rows[4][1]),
                   (n + 3, "one"), (n + 4, "ONE"), (None, rows[7][1]), (None, "alone of no id")]


@pytest.mark.parametrize("seed,k,num,den,group", [(1, 3, 90, 100, 150), (2, 3, 90, 100, 0), (3, 5, 8, 10, 120)])
def test_components_equal_brute_force(spark, seed, k, num, den, group, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 8)
    monkeypatch.setattr(J, "BLOCK", 40)
    rows = corpus(seed, 260, group)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    got = sorted((tuple(r) for r in J.join(df.repartition(4), k, num, den).collect()), key=str)
    assert got == brute(rows, k, num, den)


def test_dedup_keeps_one_row_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(3, long, "a"), (2, long + " x", "b"), (9, "other text here", None), (4, None, "c"), (9, "other text here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = sorted((tuple(r) for r in J.dedup(df).collect()), key=str)
    assert got == [(2, long + " x", "b"), (4, None, "c"), (9, "other text here", None)]


def test_empty_table(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (200, 100)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 100}


def test_dedup_keeps_another_text_under_the_id_of_a_copy(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (1, b + " more of it", 3), (7, a.upper(), 4), (1, a.replace(" ", "  "), 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __loser int")
    got = sorted(tuple(r) for r in J.dedup(df).collect())
    # a and its copies leave one row, b and its near copy the other; unrelated texts may share an id
    assert [r[:2] for r in got if r[1].startswith("b")] == [(1, b + " more of it")]
    assert len(got) == 2 and {r[0] for r in got} == {1}


def test_one_large_family_is_joined_in_proportion_to_its_size(spark, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 8)
    monkeypatch.setattr(J, "BLOCK", 20)
    rng = random.Random(9)
    base = [f"w{rng.randrange(200)}" for _ in range(400)]
    rows = []
    for d in range(240):  # one word of 400 is changed: near the first and last copy, too
        w = list(base)
        w[rng.randrange(400)] = f"x{d}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, " ".join(base[:200] + [f"y{d}.{i}" for i in range(60)])) for d in range(12)]  # half of it
    compared = []
    whole = J._forest
    monkeypatch.setattr(J, "_forest", lambda *a: compared.append(1) or whole(*a))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in J.join(df, 5, 8, 10).collect()), key=str)
    assert got == brute(rows, 5, 8, 10)
    assert {c for d, _, c in got if d < 1000} == {0}
