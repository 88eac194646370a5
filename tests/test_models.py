"""Model training: metrics within a band (no row-level oracle for trees)."""

from pyspark.sql import functions as F

from orderpulse import NUMERIC_FEATURES
from orderpulse.operators import models as mdl
from orderpulse.operators import preprocess as pre
from orderpulse.plans import catalog

SF = "/root/testdata/sf0.001"


def test_boosting_band_and_responses(spark):
    m = catalog.QUERIES["train_boosting"](spark, SF).first()
    assert 0.6 <= m.accuracy <= 1.0 and 0.6 <= m.roc_auc <= 1.0
    s = catalog.QUERIES["score_batch"](spark, SF)
    r = s.first()
    assert r.label == ("positive" if r.prediction == 1 else "negative")
    assert 0.0 <= r.probability <= 1.0


def test_forest_band_and_leaderboard(spark):
    m = catalog.QUERIES["train_forest"](spark, SF).first()
    assert 0.6 <= m.accuracy <= 1.0 and 0.6 <= m.roc_auc <= 1.0
    lb = catalog.QUERIES["run_leaderboard"](spark, SF).collect()
    assert len(lb) == 3 and sum(r.is_best for r in lb) == 1
    again = next(r for r in lb if r.run_name == "boosting_retrained")
    assert 0.6 <= again.accuracy <= 1.0


def test_median_standardizer_population_std(spark):
    import numpy as np
    xs = [1.0, 2.0, None, 10.0, 7.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    m = pre.MedianStandardizer(inputCols=["x"], outputCols=["z"]).fit(df)
    arr = np.array([1.0, 2.0, np.median([1, 2, 10, 7]), 10.0, 7.0])
    expect = (arr - arr.mean()) / arr.std()
    got = [r.z for r in m.transform(df).collect()]
    assert np.allclose(got, expect)


def test_onehot_unknown_all_zero(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    tr = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    te = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    stages = [pre.ConstantImputer(inputCols=["c"], outputCols=["cf"])]
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    stages += [StringIndexer(inputCols=["cf"], outputCols=["ci"], handleInvalid="keep",
                             stringOrderType="alphabetAsc"),
               OneHotEncoder(inputCols=["ci"], outputCols=["cv"], dropLast=True)]
    model = Pipeline(stages=stages).fit(tr)
    rows = model.transform(te).select(vector_to_array("cv").alias("v")).collect()
    # categories sorted: a, b, missing
    assert [list(r.v) for r in rows] == [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 1.0]]


def test_negative_threshold(spark):
    model, _ = catalog.trained(spark, SF, mdl.BOOSTING, "boosting")
    test = catalog.split_features(spark, SF).where("split = 'test'")
    a = mdl.score(model, test, 0.5).agg(F.sum("y_pred")).first()[0]
    b = mdl.score(model, test, 0.2).agg(F.sum("y_pred")).first()[0]
    assert b <= a  # a lower bar on P(negative) flags at least as many negatives
    assert NUMERIC_FEATURES[0] in test.columns


def test_weight_two_counts_as_the_row_twice(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [(float(x) if i % 7 else None, float(rng.integers(0, 9)), int(w))
            for i, (x, w) in enumerate(zip(rng.integers(0, 40, 61), rng.integers(0, 4, 61)))]
    df = spark.createDataFrame(rows, "x double, y double, w int")
    twice = spark.createDataFrame([r for r in rows for _ in range(r[2])], "x double, y double, w int")
    ins = ["x", "y"]
    fit = lambda d, **k: pre.MedianStandardizer(inputCols=ins, outputCols=ins, **k).fit(d)
    a, b = fit(df, weightCol="w"), fit(twice)
    for p in ("medians", "means", "scales"):
        assert np.allclose(a.getOrDefault(p), b.getOrDefault(p), rtol=1e-12), p


def test_boosting_does_not_depend_on_its_partitions(spark):
    split = catalog.split_features(spark, SF)
    spec = {**mdl.BOOSTING, "maxIter": 5}
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    p = [{r["order_id"]: r["y_proba"] for r in mdl.score(mdl.train(train, spec, partitions=n), test).collect()}
         for n in (1, 7)]
    assert p[0].keys() == p[1].keys() and all(abs(p[0][k] - p[1][k]) < 1e-9 for k in p[0])


def test_scorecard_equals_counting_and_handles_the_unseen(spark):
    import math
    import random

    from orderpulse.operators import scorecard
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(1, 30)]), rng.choice(["a", "b", None]), int(rng.random() < 0.7)) for i in range(400)]
    df = spark.createDataFrame([(i, None if v is None else float(v), c, y) for i, v, c, y in rows],
                               "id long, v double, c string, y int")
    card = scorecard.fit(df, ["v"], ["c"], "y")
    pos, neg = sum(r[3] for r in rows), sum(1 - r[3] for r in rows)
    for c in ("a", "b", None):
        p, n = (sum(r[2] == c and r[3] == y for r in rows) for y in (1, 0))
        assert card.weights["c"][c or "missing"] == math.floor(
            1e6 * math.log(((p + 1) / (pos + 10)) / ((n + 1) / (neg + 10))))
    assert len(card.edges["v"]) == 9 and "missing" in card.weights["v"]
    new = spark.createDataFrame([(1, 5.0, "zz"), (2, None, None), (3, float("nan"), "a")], "id long, v double, c string")
    got = {r["id"]: r for r in card.score(new).collect()}
    cut = str(sum(e <= 5.0 for e in card.edges["v"]))
    want = {1: card.weights["v"][cut] + card.unseen, 2: card.weights["v"]["missing"] + card.weights["c"]["missing"],
            3: card.weights["v"]["missing"] + card.weights["c"]["a"]}
    for i, w in want.items():
        logit = card.prior + w
        assert abs(got[i]["y_proba"] - 1 / (1 + math.exp(-logit / 1e6))) < 1e-12 and got[i]["y_pred"] == (logit >= 0)


def test_forest_scores_in_a_session_that_observed_a_query(spark):
    from pyspark.sql import Observation
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    f = catalog.features(spark, SF)
    model = mdl.train(f, {**mdl.FOREST, "numTrees": 2, "maxDepth": 3}, partitions=2)
    assert mdl.score(model, f).agg(F.count("y_proba")).first()[0] == f.count()


def test_a_logged_run_scores_its_test_rows_once(spark, tmp_path):
    import random

    from orderpulse import CATEGORICAL_FEATURES, KEY, LABEL
    rng = random.Random(5)
    cols = [KEY, LABEL, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
    rows = [(i, int(x + rng.random() > 1), *[x if rng.random() > 0.1 else None for _ in NUMERIC_FEATURES],
             *[rng.choice(["a", "b", None]) for _ in CATEGORICAL_FEATURES])
            for i, x in ((i, rng.random()) for i in range(120))]
    schema = ", ".join([f"{KEY} long", f"{LABEL} int", *[f"{c} double" for c in NUMERIC_FEATURES],
                        *[f"{c} string" for c in CATEGORICAL_FEATURES]])
    df = spark.createDataFrame(rows, schema).select(*cols)
    train, test = df.where(F.col(KEY) < 80), df.where(F.col(KEY) >= 80)
    model, metrics = mdl.train_and_log(
        spark, train, test, {**mdl.FOREST, "numTrees": 3, "maxDepth": 4, "partitions": 2}, "once",
        str(tmp_path / "runs"), str(tmp_path / "model"))
    # every pass of the metrics reads the written scores, none scores again
    files = metrics.inputFiles()
    assert files and all("model_scores" in f for f in files)
    assert metrics.first() == mdl.evaluate(mdl.score(model, test)).first() and metrics.first().n_test == 40
    logged = spark.read.parquet(str(tmp_path / "runs")).first().metrics
    assert logged["accuracy"] == metrics.first().accuracy


def _forest_rows(spark, n=400):
    import random

    from pyspark.ml.linalg import Vectors
    rng = random.Random(8)
    xs = [[rng.random(), rng.random(), float(rng.randrange(5)), rng.random() * (i % 3)] for i in range(n)]
    rows = [(i, Vectors.dense(x), float(x[0] + x[2] * x[3] / 4 + rng.random() / 2 > 1)) for i, x in enumerate(xs)]
    rows += rows[:40]  # keys may repeat
    return spark.createDataFrame(rows, ["id", "features", "_label"]).repartition(16, "id").sortWithinPartitions("id")


def test_forest_is_sparks_own_tree_for_tree_from_fewer_partitions(spark):
    from pyspark.ml.classification import RandomForestClassifier
    sc, df = spark.sparkContext, _forest_rows(spark).cache()
    spec = {**mdl.FOREST, "numTrees": 7, "maxDepth": 12}
    est = mdl._estimator(spec)
    sc.setJobGroup("forest-partitions", "forest")
    got = est.fit(df)
    sc._jsc.clearJobGroup()
    own = RandomForestClassifier(**{p.name: v for p, v in est.extractParamMap().items()}).fit(df).copy()
    assert [t.toDebugString.split("\n")[1:] for t in got.trees] == [t.toDebugString.split("\n")[1:] for t in own.trees]
    assert [t.numNodes for t in got.trees] == [t.numNodes for t in own.trees] and got.totalNumNodes > 7 * 20
    key = lambda r: (r["id"], list(r["probability"]), r["prediction"])
    assert sorted(map(key, got.transform(df).collect())) == sorted(map(key, own.transform(df).collect()))
    # the rows are drawn in 16 partitions, their statistics summed in no more than the cores
    track = sc.statusTracker()
    stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup("forest-partitions") for s in track.getJobInfo(j).stageIds]
    passes = [s.numTasks for s in stages if s and "RandomForest" in s.name and "mapPartitions" in s.name]
    assert passes and max(passes) <= sc.defaultParallelism < 16


def test_weighted_forest_stays_sparks_own(spark):
    from pyspark.ml.classification import RandomForestClassifier
    df = _forest_rows(spark, 120).withColumn("w", F.lit(1.0) + F.col("id") % 3)
    est = mdl._estimator({**mdl.FOREST, "numTrees": 3, "maxDepth": 4}).setWeightCol("w")
    own = RandomForestClassifier(**{p.name: v for p, v in est.extractParamMap().items()}).fit(df)
    assert [t.toDebugString.split("\n")[1:] for t in est.fit(df).trees] == [t.toDebugString.split("\n")[1:] for t in own.trees]


def _boosting_rows(spark, n=700):
    import random

    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    rng = random.Random(12)
    rows = [(rng.random(), float(rng.randrange(4)), rng.gauss(0, 1), rng.choice("abc"), rng.choice("uvwxy")) for _ in range(n)]
    rows = [(i, a, b, c, s, t, float(a + b / 4 + c * (s == "b") + (t == "y") + rng.random() / 2 > 1))
            for i, (a, b, c, s, t) in enumerate(rows)]
    df = spark.createDataFrame([*rows, *rows[:50]], "id long, a double, b double, c double, s string, t string, _label double")
    idx = StringIndexer(inputCols=["s", "t"], outputCols=["si", "ti"], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=["si", "ti"], outputCols=["sv", "tv"], dropLast=True)
    put = VectorAssembler(inputCols=["a", "sv", "b", "tv", "c"], outputCol="features")
    df = Pipeline(stages=[idx, hot, put]).fit(df).transform(df)
    return df.select("id", "features", "_label").repartition(3, "id").sortWithinPartitions("id").cache()


def _shape(node):
    """A tree's splits, gains and values, floats to nine digits."""
    num = lambda v: float(f"{v:.9g}")
    if node.getClass().getSimpleName() == "LeafNode":
        return num(node.prediction())
    split = node.split()
    at = num(split.threshold()) if split.getClass().getSimpleName() == "ContinuousSplit" else list(split.leftCategories())
    return (num(node.prediction()), num(node.gain()), split.featureIndex(), at, _shape(node.leftChild()), _shape(node.rightChild()))


def test_boosting_is_sparks_own_and_holds_bytes_not_vectors(spark, tmp_path, monkeypatch):
    from pyspark.ml.classification import GBTClassificationModel, GBTClassifier

    from orderpulse.operators import boosting
    df = _boosting_rows(spark)
    est = mdl._estimator({**mdl.BOOSTING, "maxIter": 9})
    monkeypatch.setattr(boosting, "BLOCKS_FROM", 0)
    assert isinstance(est, boosting.BoostingClassifier)
    own = GBTClassifier()._set(**{p.name: v for p, v in est.extractParamMap().items()}).fit(df)
    # the rows of a pass are blocks, whatever their size and whenever scores are summed anew
    for rounds, size in ((25, 16_384), (4, 64)):
        monkeypatch.setattr(boosting, "LINEAGE_ROUNDS", rounds)
        monkeypatch.setattr(boosting, "BLOCK_ROWS", size)
        got = est.fit(df)
        a, b = ([_shape(t._java_obj.rootNode()) for t in m.trees] for m in (got, own))
        assert a == b and got.treeWeights == own.treeWeights and got.numFeatures == own.numFeatures
        assert [t.numNodes for t in got.trees] == [t.numNodes for t in own.trees]
    path = str(tmp_path / "m")
    got.write().save(path)
    key = lambda m: {r["id"]: r["probability"][1] for r in m.transform(df).collect()}
    p, q, r = key(got), key(own), key(GBTClassificationModel.load(path))
    assert p == r and all(abs(p[k] - q[k]) < 1e-12 for k in q)
    cut = boosting._worker(2, {0: [0.5]}, [1], 8)[0]
    import pickle

    import pyarrow as pa
    batch = pa.record_batch({"y": pa.array([0.0, 1.0]), "x": pa.array([[0.5, 1.0], [0.6, 0.0]])})
    bins, ids, y = pickle.loads(next(cut(iter([batch])))["block"][0].as_py())
    assert bins.tolist() == [[0, 1]] and ids.tolist() == [[1, 0]] and y.tolist() == [-1, 1]
    assert bins.itemsize == ids.itemsize == y.itemsize == 1


def test_boosting_of_one_class_and_weighted_boosting(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    from orderpulse.operators import boosting
    monkeypatch.setattr(boosting, "BLOCKS_FROM", 0)
    df = _boosting_rows(spark, 90)
    est = mdl._estimator({**mdl.BOOSTING, "maxIter": 3})
    own = lambda e, rows: GBTClassifier()._set(**{p.name: v for p, v in e.extractParamMap().items()}).fit(rows)
    # one class leaves nothing to split but rounding: the trees may differ, their values not
    same = df.withColumn("_label", F.lit(1.0))
    p, q = ({r["id"]: r["probability"][1] for r in m.transform(same).collect()} for m in (est.fit(same), own(est, same)))
    assert p.keys() == q.keys() and all(abs(p[k] - q[k]) < 1e-12 for k in p)
    heavy, e = df.withColumn("w", F.lit(1.0) + F.col("id") % 2), est.copy().setWeightCol("w")
    a, b = ([_shape(t._java_obj.rootNode()) for t in m.trees] for m in (e.fit(heavy), own(e, heavy)))
    assert a == b
