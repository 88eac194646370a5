"""Golden micro-fixtures for the type / null / rounding traps."""

import math
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from orderpulse.functions import columns as C
from orderpulse.operators import features as feat
from orderpulse.operators import metrics as met


def test_floor_days_partial_days(spark):
    # -23 h -> -1 (floor), +25 h -> 1, calendar-day counting would say 2 / 0
    df = spark.createDataFrame(
        [(datetime(2020, 1, 1, 1), datetime(2020, 1, 2, 0)),
         (datetime(2020, 1, 2, 1), datetime(2020, 1, 1, 0)),
         (datetime(2020, 1, 1, 23), datetime(2020, 1, 1, 1)),
         (None, datetime(2020, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    out = [r[0] for r in df.select(C.floor_days("a", "b")).collect()]
    assert out == [-1.0, 1.0, 0.0, None]


def test_mode_ties_smallest_and_all_null(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, None), (3, "z"),
                                (3, None), (None, "q")], "k int, v string")
    got = {r.k: r.v for r in feat.group_mode(df, "k", "v").collect()}
    assert got == {1: "a", 2: None, 3: "z"}  # NULL key dropped


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    r = df.select(F.avg(C.nan_to_null("x")).alias("m")).first()
    assert r.m == 2.0


def test_strip_unicode_matches_python(spark):
    texts = [" a ", " 　b\t\n", "\x1c c\x1f", " \t \n　", "d ", "e"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.strip_unicode("t")).collect()]
    assert got == [t.strip() for t in texts]


def test_preview_and_stars(spark):
    df = spark.createDataFrame([("x" * 61, "4 stars"), ("short", "1 star"), ("y" * 60, "bad")],
                               "t string, l string")
    rows = df.select(C.preview("t").alias("p"), C.parse_stars("l").alias("s")).collect()
    assert rows[0].p == "x" * 60 + "..." and rows[1].p == "short" and rows[2].p == "y" * 60
    assert [r.s for r in rows] == [4, 1, None]


def test_bin_index_equals_numpy_histogram(spark):
    rng = np.random.default_rng(7)
    ref = np.round(rng.exponential(10, 500), 1)
    cur = np.concatenate([ref[:50], [ref.min(), np.quantile(ref, 0.99), 1e9, -5.0]])
    lo, hi = ref.min(), np.quantile(ref, 0.99)
    edges = np.linspace(lo, hi, 11)
    edges[0], edges[-1] = -np.inf, np.inf
    expect, _ = np.histogram(cur, bins=edges)
    df = spark.createDataFrame([(float(v),) for v in cur], "v double")
    inner = C.linspace_inner(F.lit(float(lo)), F.lit(float(hi)), 10)
    got = dict(df.groupBy(C.bin_index("v", inner).alias("b")).count().collect())
    assert [got.get(i, 0) for i in range(10)] == list(expect)


def test_bin_index_all_edges_equal(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (0.5,)], "v double")
    inner = C.linspace_inner(F.lit(1.0), F.lit(1.0), 10)
    got = sorted(r[0] for r in df.select(C.bin_index("v", inner)).collect())
    # numpy: edges all 1.0 -> 0.5 in bin 0, 1.0 and 2.0 in the last bin
    assert got == [0, 9, 9, 9]


def test_safe_div_and_severity(spark):
    df = spark.createDataFrame([(1, 0, 0.05), (1, 2, 0.15), (0, 0, float("nan"))],
                               "a int, b int, p double")
    rows = df.select(C.safe_div("a", "b").alias("d"), C.severity("p").alias("s")).collect()
    assert [r.d for r in rows] == [0.0, 0.5, 0.0]
    assert [r.s for r in rows] == ["GREEN", "YELLOW", "RED"]


def test_bround_half_even(spark):
    df = spark.createDataFrame([(0.73625,), (0.12345,)], "p double")
    got = [r[0] for r in df.select(F.bround("p", 4)).collect()]
    assert got[0] == round(0.73625, 4)


def test_hash_uniform_range_and_stability(spark):
    df = spark.range(1000).repartition(7)
    u = df.select("id", C.hash_uniform(42, "id").alias("u"))
    a = {r.id: r.u for r in u.collect()}
    b = {r.id: r.u for r in spark.range(1000).repartition(2)
         .select("id", C.hash_uniform(42, "id").alias("u")).collect()}
    assert a == b and all(0.0 <= v < 1.0 for v in a.values())


def test_ks_pvalue_limits(spark):
    df = spark.createDataFrame([(0.0, 100, 100), (0.5, 100, 100), (0.05, 10000, 10000)],
                               "d double, a long, b long")
    p = [r[0] for r in df.select(C.ks_pvalue("d", "a", "b")).collect()]
    assert p[0] == 1.0 and p[1] < 1e-9
    en = 5000.0
    series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * en * 0.05 ** 2) for k in range(1, 101))
    assert abs(p[2] - series) < 1e-12


def test_auc_exact_with_ties(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0]
    s = [0.9, 0.9, 0.8, 0.3, 0.3, 0.1, 0.5, 0.6]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    for buckets in (None, 2, 64):
        got = met.roc_auc(df, "y", "s", buckets=buckets).first().auc
        assert abs(got - brute) < 1e-15


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert met.roc_auc(df, "y", "s").first().auc is None


def test_confusion_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")
    r = met.confusion_metrics(df, "y", "p").first()
    assert r.accuracy == 1.0 and r.precision_neg == 0.0 and r.recall_neg == 0.0
    assert r.f1_macro == 0.5


def test_exact_quantile_equals_numpy(spark):
    rng = np.random.default_rng(11)
    vals = np.round(rng.lognormal(3, 1, 997), 2).tolist() + [5.0] * 40
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(vals)],
                               "g string, v double")
    pdf = df.toPandas()
    for q in (0.0, 0.01, 0.37, 0.5, 0.99, 1.0):
        got = {r.g: r.q for r in met.exact_quantile(df, "v", q, "g", buckets=8).collect()}
        for g, part in pdf.groupby("g"):
            assert got[g] == float(np.quantile(part.v.values, q)), (g, q)
    whole = met.exact_quantile(df, "v", 0.99).first().q
    assert whole == float(np.quantile(pdf.v.values, 0.99))


def test_exact_ks_p_value_equals_enumeration(spark):
    from itertools import combinations

    from orderpulse.functions.columns import ks_exact_pvalue

    def every_order(d, n, m):
        hit = total = 0
        for pick in combinations(range(n + m), n):
            i, most = 0, 0
            for k in range(1, n + m + 1):
                i += k - 1 in pick
                most = max(most, abs(i * m - (k - i) * n))
            total += 1
            hit += most >= round(d * n * m)
        return hit / total
    rows = [(h / (n * m), n, m) for n, m in ((1, 1), (3, 2), (2, 5), (4, 4), (1, 7), (6, 4)) for h in range(n * m + 1)]
    df = spark.createDataFrame([*rows, (None, 3, 2), (0.5, 0, 2)], "d double, n int, m int")
    got = {(r["d"], r["n"], r["m"]): r["p"] for r in df.select("*", ks_exact_pvalue("d", "n", "m").alias("p")).collect()}
    assert got.pop((None, 3, 2)) is None and got.pop((0.5, 0, 2)) is None
    for (d, n, m), p in got.items():
        assert abs(p - every_order(d, n, m)) < 1e-12, (d, n, m)


def test_cost_curve_equals_counting_and_marks_the_cheapest(spark):
    import random
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.randrange(101) / 100) for _ in range(300)] + [(None, 0.4), (1, None)]
    df = spark.createDataFrame(rows, "y int, p double")
    got = met.cost_curve(df, "y", "p", 5.0, 1.0, steps=20).orderBy("step").collect()
    import math
    step = [(y, min(math.floor((1 - p) * 20), 20)) for y, p in rows if y is not None and p is not None]
    want = [5.0 * sum(y == 0 and s < k for y, s in step) + sum(y == 1 and s >= k for y, s in step) for k in range(21)]
    assert [r["cost"] for r in got] == want and sum(r["is_best"] for r in got) == 1
    assert next(r for r in got if r["is_best"])["cost"] == min(want)
