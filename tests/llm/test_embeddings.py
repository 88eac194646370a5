"""NN-descent near-duplicates against brute force."""

import numpy as np

from orderpulse.llm import nn_descent as N


def brute(rows, threshold):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    links = [0] * len(rows)
    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), d), d)
    return {d: (links[i], first[find(i)], first[find(i)] == d) for i, (d, _) in enumerate(rows)}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 32)
    monkeypatch.setattr(N, "BLOCK", 40)
    rng = np.random.default_rng(4)
    rows, d = [], 0
    for size in [1] * 150 + [2] * 30 + [5] * 8 + [90]:
        c = rng.standard_normal(24)
        for _ in range(size):
            rows.append((d, (c + 0.12 * rng.standard_normal(24)).tolist()))
            d += 1
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(30)] + [(1100, [2 * x for x in hot])]
    rows += [(1200, None), (1201, []), (1202, [0.0] * 24), (1203, [float("nan")] + hot[1:]), (1204, [None] + hot[1:]),
             (1205, [float("inf")] + hot[1:]), (1206, hot[:8]), (1207, [1e300 * x for x in hot])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, v string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in N.near_duplicates(df.repartition(4)).collect()}
    truth = brute([(i, v if i != 1207 else hot) for i, v in rows], 0.9)
    same = sum(got[i] == truth[i] for i in truth)
    assert len(got) == len(rows) and same >= 0.99 * len(rows)
    assert all(got[i] == truth[i] for i in truth if i >= 1000)


def test_saturated_groups_keep_the_links_between_them(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 32)
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.sqrt(v @ v)
    rows = [rng.standard_normal(24) for _ in range(300)]
    for sizes in [(30, 30), (20, 25, 40)]:
        c = unit(rng.standard_normal(24))
        for size in sizes:  # inside about 0.99, to the group before about 0.93
            rows += [c + 0.02 * rng.standard_normal(24) for _ in range(size)]
            off = rng.standard_normal(24)
            c = 0.94 * c + (1 - 0.94**2) ** 0.5 * unit(off - (off @ c) * c)
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in N.near_duplicates(df.repartition(4)).collect()}
    truth = brute(rows, 0.9)
    assert len({truth[i][1] for i in range(300, 360)}) == 1 and min(truth[i][0] for i in range(300, 360)) > 30
    assert got == truth


def test_pairs_missed_beside_a_large_family_are_found(spark, monkeypatch):
    """Search that finds nothing but the large family: the audit must see it and the result be whole."""
    monkeypatch.setattr(N, "CHUNK", 64, raising=False)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(16)
    rows = [(centre + 0.05 * rng.standard_normal(16)).tolist() for _ in range(120)]
    for _ in range(60):
        v = rng.standard_normal(16)
        rows += [v.tolist(), (v + 0.05 * rng.standard_normal(16)).tolist()]
    rows = list(enumerate(rows))
    large = {tuple(v) for _, v in rows[:120]}
    search = N._lists

    def blind(edges, k):
        nodes = edges.sparkSession.createDataFrame([(list(map(float, v)),) for v in large], "embedding array<double>")
        seen = N.vector_nodes(nodes.withColumn("vec_id", N.F.lit(0))).select(N.F.col("node").alias("src"))
        return search(edges, k).join(seen, "src", "left_semi")

    monkeypatch.setattr(N, "_lists", blind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for more in ({}, {"attempts": 1, "linked": 20, "sample": 40}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in
               N.near_duplicates(df.repartition(4), trees=1, rounds=0, **more).collect()}
        assert got == brute(rows, 0.9)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert N.near_duplicates(df.where("false")).collect() == []
    assert [tuple(r) for r in N.near_duplicates(df).collect()] == [(5, 0, 5, True)]


def test_a_null_id_is_kept_only_when_it_names_its_component(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(2, v), (None, v), (None, [9.0, -1.0, 0.5]), (5, [-3.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((str(r["vec_id"]), str(r["component_id"]), r["kept"]) for r in N.near_duplicates(df).collect())
    assert got == [("2", "2", True), ("5", "5", True), ("None", "2", False), ("None", "None", True)]
