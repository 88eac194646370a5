"""Readers, model store, external text scorer, fused vs unfused feature build."""

import os

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from orderpulse import KEY
from orderpulse.operators import features as feat
from orderpulse.operators import models as mdl
from orderpulse.operators import text as txt
from orderpulse.operators import validate as val
from orderpulse.plans import catalog
from orderpulse.sources.tables import land_tables, read_tables, shape_report

SF = "/root/testdata/sf0.001"


def test_csv_reader_multiline_and_coercion(spark, tmp_path):
    base = tmp_path / "csv"
    base.mkdir()
    (base / "orders.csv").write_text(
        "order_id,order_purchase_timestamp,order_delivered_customer_date,order_estimated_delivery_date\n"
        "a,2018-01-01 10:00:00,2018-01-05 09:00:00,2018-01-10 00:00:00\n"
        "b,2018-01-01 10:00:00,not a date,2018-01-10 00:00:00\n")
    (base / "order_reviews.csv").write_text(
        'review_id,order_id,review_score,review_comment_message\n'
        'r1,a,5,"line one\nline two, with comma"\n'
        'r2,b,2,\n')
    (base / "order_items.csv").write_text(
        "order_id,order_item_id,product_id,seller_id,price,freight_value\n"
        "a,1,p,s,10.5,NaN\n")
    t = read_tables(spark, str(base), "csv", ["orders", "order_reviews", "order_items"])
    o = {r.order_id: r for r in t["orders"].collect()}
    assert o["b"].order_delivered_customer_date is None
    assert o["a"].order_delivered_customer_date is not None
    rv = {r.review_id: r for r in t["order_reviews"].collect()}
    assert rv["r1"].review_comment_message == "line one\nline two, with comma"
    assert rv["r2"].review_comment_message is None
    assert t["order_items"].first().freight_value is None  # NaN -> NULL
    d = feat.delivery_days(t["orders"]).where("order_id = 'a'").first()
    assert d.delivery_days == 3.0 and d.delivery_vs_estimated == -5.0
    shapes = {r.table: (r.n_rows, r.n_columns) for r in shape_report(t).collect()}
    assert shapes["orders"] == (2, 4)
    landed = land_tables(t, str(tmp_path / "parquet"))
    assert landed["order_reviews"].where("review_id = 'r1'").first().review_comment_message \
        == "line one\nline two, with comma"
    assert sorted(landed["orders"].columns) == sorted(t["orders"].columns)


def test_fused_equals_unfused(spark):
    t = catalog.tables(spark, SF)
    assert feat.dimensions_unique(t)
    sums = ["total_order_value", "avg_product_price", "total_freight_value", "avg_freight_value"]
    # equal up to summation order (compared at the 1e-6 report precision)
    a = catalog.snapped(feat.order_features(t, fused=True).drop("order_purchase_timestamp"), sums)
    b = catalog.snapped(feat.order_features(t, fused=False).drop("order_purchase_timestamp"), sums)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_duplicate_dimension_key_falls_back(spark):
    t = dict(catalog.tables(spark, SF))
    t["sellers"] = t["sellers"].unionByName(t["sellers"].limit(1))
    assert not feat.dimensions_unique(t)


def test_model_store_roundtrip(spark):
    model, _ = catalog.trained(spark, SF, mdl.BOOSTING, "boosting")
    from orderpulse.plans.store import stage_path
    loaded = PipelineModel.load(stage_path(spark, "model_boosting", SF))
    test = catalog.split_features(spark, SF).where("split = 'test'")
    a = mdl.score(model, test).select(KEY, "y_proba").orderBy(KEY).collect()
    b = mdl.score(loaded, test).select(KEY, "y_proba").orderBy(KEY).collect()
    assert a == b


def test_batch_responses_in_order(spark):
    rows = [(1, 2, 0.9, 1), (1, 0, 0.2, 0), (1, 1, 0.73625, 1), (2, 0, 0.5, 0)]
    df = spark.createDataFrame(rows, "batch_id int, pos int, y_proba double, y_pred int")
    out = {r.batch_id: r for r in mdl.batch_responses(df, "batch_id").collect()}
    assert [p.probability for p in out[1].predictions] == [0.2, 0.7362, 0.9]
    assert [p.label for p in out[1].predictions] == ["negative", "positive", "positive"]
    assert out[2].body == '{"predictions":[{"prediction":0,"probability":0.5,"label":"negative"}]}'


def test_external_text_scorer_batches(spark):
    calls = []

    def factory():
        def scorer(texts):
            calls.append(len(texts))
            return [("5 stars" if "good" in t else "1 star", 0.9) for t in texts]
        return scorer

    df = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(70)], "id int, t string")
    out = txt.score_text_batches(df.coalesce(1), "t", factory, batch=32)
    rows = out.collect()
    assert len(rows) == 70 and all((r.text_label == "5 stars") == (r.id % 2 == 1) for r in rows)
    s = txt.stars_to_binary(out, "text_label")
    assert s.where("pred_binary = 1").count() == 35


def test_route_queue_no_double_queue(spark):
    f = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.8)], "order_id int, y_proba double")
    t = spark.createDataFrame([(1, 0, 0.7), (2, 0, 0.6), (3, 1, 0.9)],
                              "order_id int, pred_binary int, text_score double")
    got = {(r.order_id, r.reason) for r in txt.route(f, t).collect()}
    assert got == {(1, "outreach"), (2, "human_review")}


def test_stars_crosstab_gaps_zero(spark):
    from orderpulse.operators import metrics as met
    df = spark.createDataFrame([(1, 5), (1, 5), (3, 2)], "p int, a int")
    rows = {r.p: [r[str(k)] for k in range(1, 6)] for r in met.crosstab(df, "p", "a", [1, 2, 3, 4, 5]).collect()}
    assert rows == {1: [0, 0, 0, 0, 2], 3: [0, 1, 0, 0, 0]}


def test_allowed_values_fixed_lists(spark):
    a = val.allowed_values(spark)
    got = {r.field: r.n for r in a.groupBy("field").agg(F.count("*").alias("n")).collect()}
    assert got == {"product_category": 74, "seller_state": 24, "payment_type": 5}
    assert os.path.exists("/root/repo/orderpulse")  # package layout present
    assert isinstance(pd.__version__, str)


def test_csv_landing_quarantines_broken_lines_and_resumes_by_file(spark, tmp_path):
    from orderpulse.sources import tables as tb
    src, base = tmp_path / "in", f"{tmp_path}/out"
    src.mkdir()
    head = "order_id,order_item_id,product_id,seller_id,price,freight_value\n"
    (src / "a.csv").write_text(head + 'o1,1,p1,s1,9.5,1.0\no2,1,p1,s1,n/a,1.0\no3,2,"p\nq",s1,NaN,\n')
    (src / "b.csv").write_text(head + "o4,1\no5,1,p2,s2,3.0,0.5,more\n")
    (src / "empty.csv").write_text(head)
    first = tb.land_csv(spark, str(src), "order_items", base)
    assert sorted((r["file"][-5:], r["n_good"], r["n_bad"]) for r in first.collect()) == [
        ("a.csv", 2, 1), ("b.csv", 0, 2), ("y.csv", 0, 0)]
    assert tb.land_csv(spark, str(src), "order_items", base).count() == 0
    (src / "c.csv").write_text(head + "o6,1,p1,s1,2.0,1.0\n")
    assert [(r["n_good"], r["n_bad"]) for r in tb.land_csv(spark, str(src), "order_items", base).collect()] == [(1, 0)]
    good, bad = tb.read_landed(spark, base, "order_items")
    assert sorted((r["order_id"], r["product_id"], r["price"]) for r in good.collect()) == [
        ("o1", "p1", 9.5), ("o3", "p\nq", None), ("o6", "p1", 2.0)]
    assert sorted(r["line"].split(",")[0] for r in bad.collect()) == ["o2", "o4", "o5"]
    # a run cut short before its last step writes the same folders again
    import shutil
    shutil.move(f"{base}/files", f"{tmp_path}/files-lost")
    tb.land_csv(spark, str(src), "order_items", base)
    assert tb.read_landed(spark, base, "order_items")[0].count() == 3


def test_star_model_scores_each_text_without_its_own_ratings(spark):
    from orderpulse.operators import text as txt
    words = {1: "awful broken late", 5: "lovely quick perfect"}
    docs = [(i, f"{words[5 if i % 2 else 1]} item {i}") for i in range(80)]
    ratings = [(i, 5 if i % 2 else 1) for i in range(80)]
    # one text has a word of its own, and the wrong rating: its model has not seen either
    docs[10], ratings[10] = (10, "awful broken late secretword"), (10, 5)
    d = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    r = spark.createDataFrame(ratings, "doc_id long, review_score int")
    got = {x["doc_id"]: x for x in txt.out_of_fold_stars(d, r).collect()}
    assert len(got) == 82
    assert all(got[i]["pred_stars"] == (5 if i % 2 else 1) and got[i]["text_score"] > 0.9 for i in range(80))
    assert 0.2 <= got[900]["text_score"] <= 0.6 and got[900]["pred_stars"] == got[901]["pred_stars"]
