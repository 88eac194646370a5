"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables for one scale factor through the
stand-in views and runs one operator (or a short chain) over all rows.
Float columns that are sums over many rows are reported at 1e-6 (``snap``)
so that summation order cannot change the printed value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse import CATEGORICAL_FEATURES, KEY, LABEL, NUMERIC_FEATURES
from orderpulse.functions.columns import snap
from orderpulse.operators import features as feat
from orderpulse.plans.store import materialize, memo, stage_path
from orderpulse.session import ensure_checkpoint_dir
from orderpulse.sources import standin
from orderpulse.sources.standin import standin_tables
from orderpulse.sources.tables import read_driver_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def prepare(spark: SparkSession) -> None:
    """Session requirements of every query: UTC session time (the data's
    timestamps are zone-less; day differences and event-time windows must
    not shift with a local zone's daylight saving) and a checkpoint folder."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        return run
    return deco


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return standin_tables(spark, sf_dir)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table, built once per session and read back (store.py)."""
    return materialize(spark, "order_features", sf_dir,
                       lambda: feat.order_features(tables(spark, sf_dir)))


def snapped(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[snap(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- step 1: feature build ---------------------------------------------------

@register("order_features")
def q_order_features(spark, sf_dir):
    """The full fused build (not the materialised copy), so it is measured."""
    df = feat.order_features(tables(spark, sf_dir)).drop("order_purchase_timestamp")
    return snapped(df, ["total_order_value", "avg_product_price", "total_freight_value",
                        "avg_freight_value"])


@register("review_label")
def q_review_label(spark, sf_dir):
    return feat.review_labels(tables(spark, sf_dir)["order_reviews"])


@register("item_aggregates")
def q_item_aggregates(spark, sf_dir):
    df = feat.item_aggregates(tables(spark, sf_dir)["order_items"])
    return snapped(df, ["total_order_value", "avg_product_price", "total_freight_value",
                        "avg_freight_value"])


@register("payment_mode")
def q_payment_mode(spark, sf_dir):
    return feat.group_mode(tables(spark, sf_dir)["order_payments"], KEY, "payment_type")


@register("seller_state_mode")
def q_seller_state_mode(spark, sf_dir):
    t = tables(spark, sf_dir)
    items = t["order_items"].select(KEY, "seller_id").join(t["sellers"], "seller_id", "left")
    return feat.group_mode(items, KEY, "seller_state")


@register("category_mode")
def q_category_mode(spark, sf_dir):
    t = tables(spark, sf_dir)
    prods = feat.product_categories(t["products"], t["category_translation"])
    items = t["order_items"].select(KEY, "product_id").join(prods, "product_id", "left")
    return feat.group_mode(items, KEY, "product_category")


@register("delivery_days_floor")
def q_delivery_days_floor(spark, sf_dir):
    return feat.delivery_days(tables(spark, sf_dir)["orders"]).drop("order_purchase_timestamp")


@register("photos_min")
def q_photos_min(spark, sf_dir):
    t = tables(spark, sf_dir)
    prods = t["products"].select("product_id", "product_photos_qty")
    items = t["order_items"].select(KEY, "product_id").join(prods, "product_id", "left")
    return (items.where(F.col(KEY).isNotNull()).groupBy(KEY)
            .agg(F.min("product_photos_qty").alias("min_product_photos_qty")))


@register("rating_distribution")
def q_rating_distribution(spark, sf_dir):
    rv = tables(spark, sf_dir)["order_reviews"]
    return (rv.groupBy("review_score").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .orderBy("review_score"))


@register("label_distribution")
def q_label_distribution(spark, sf_dir):
    from orderpulse.operators.metrics import distribution
    return snapped(distribution(features(spark, sf_dir), LABEL), ["share"])


# --- steps 2-5: sampling, metrics, drift, monitoring -------------------------

from orderpulse.operators import drift as drift_ops  # noqa: E402
from orderpulse.operators import metrics as met  # noqa: E402
from orderpulse.operators import monitor as mon  # noqa: E402
from orderpulse.operators import perturb  # noqa: E402
from orderpulse.operators import sampling, scorecard  # noqa: E402
from orderpulse.sources.standin import FIRST_MONTH  # noqa: E402

SEED = 42
DRIFT_FEATURES = ["delivery_days", "total_freight_value", "total_order_value"]


def tag_months(df: DataFrame, ts_col: str = "order_purchase_timestamp",
               first: str = FIRST_MONTH) -> DataFrame:
    """month = 1, 2, ... for the calendar months from ``first`` on, as many as
    the data has; 0 before them (the reference period)."""
    y0, m0 = int(first[:4]), int(first[5:7])
    idx = F.year(ts_col) * 12 + F.month(ts_col) - F.lit(y0 * 12 + m0)
    return df.withColumn("month", F.greatest(idx + 1, F.lit(0)).cast("int"))


def months_present(df: DataFrame) -> list[int]:
    """The months of the rows, in order (a few values)."""
    return [r["month"] for r in df.select("month").distinct().orderBy("month").collect()]


def feature_model(spark, sf_dir) -> Callable[[DataFrame], DataFrame]:
    """The scorecard fitted on the training split, once per session: adds y_true, y_proba, y_pred."""
    def build():
        split = sampling.stratified_split(features(spark, sf_dir), LABEL, KEY, 0.2, SEED)
        return scorecard.fit(split.where("split = 'train'"))
    card = memo(spark, "scorecard", sf_dir, build)
    return lambda df: card.score(df.withColumn("y_true", F.col(LABEL)))


def monitoring(spark, sf_dir) -> dict[str, DataFrame]:
    """Reference rows (month 0) and drifted, scored production months 1, 2, ..."""
    f = tag_months(features(spark, sf_dir))
    ref = f.where(F.col("month") == 0)
    prod = materialize(spark, "production_months", sf_dir, lambda: perturb.drift_months(
        f.where(F.col("month") > 0), perturb.scenario_table(spark),
        NUMERIC_FEATURES, LABEL, KEY, SEED))
    return {"all": f, "ref": ref, "prod": prod, "scored": feature_model(spark, sf_dir)(prod)}


def psi_long(spark, sf_dir) -> DataFrame:
    m = monitoring(spark, sf_dir)
    ref = drift_ops.to_long(m["ref"], DRIFT_FEATURES)
    cur = drift_ops.to_long(m["prod"], DRIFT_FEATURES, ["month"])
    return drift_ops.psi(ref, cur, "month")


@register("split_stratified")
def q_split_stratified(spark, sf_dir):
    f = features(spark, sf_dir).select(KEY, LABEL)
    return sampling.stratified_split(f, LABEL, KEY, 0.2, SEED)


@register("split_exact")
def q_split_exact(spark, sf_dir):
    """Exact stratified split: ceil(0.2 n) test rows of every class."""
    f = features(spark, sf_dir).select(KEY, LABEL)
    return sampling.stratified_split(f, LABEL, KEY, 0.2, SEED, exact=True)


@register("bootstrap_sample")
def q_bootstrap_sample(spark, sf_dir):
    """N draws with replacement from the test split (N = its size)."""
    test = sampling.stratified_split(features(spark, sf_dir).select(KEY, LABEL), LABEL, KEY,
                                     0.2, SEED).where("split = 'test'").drop("split")
    return sampling.bootstrap(spark, test, None, KEY, SEED, [1], "month")


@register("psi_matrix")
def q_psi_matrix(spark, sf_dir):
    p = psi_long(spark, sf_dir)
    return drift_ops.psi_with_severity(p).withColumn("psi", snap("psi"))


def stored_sketches(spark, sf_dir) -> DataFrame:
    """Sketches of every feature and production month, written once."""
    prod = monitoring(spark, sf_dir)["prod"]
    return materialize(spark, "feature_sketches", sf_dir, lambda: drift_ops.feature_sketches(
        drift_ops.to_long(prod, DRIFT_FEATURES, ["month"]), ["month"]))


@register("sketch_quantiles")
def q_sketch_quantiles(spark, sf_dir):
    """Median and 99th percentile from month 1 up to each month, from merged monthly
    sketches, held against the rows: is the rank off by 2 % of the values at most?"""
    sk = stored_sketches(spark, sf_dir)
    ends = sk.select(F.col("month").alias("upto")).distinct()
    near = F.broadcast(ends)  # a row per month
    merged = drift_ops.merged_sketches(sk.join(near, F.col("month") <= F.col("upto")), ["upto"])
    found = merged.select("feature", "upto", "n", F.explode(F.array(*[F.struct(
        F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("v"))
        for q in (0.5, 0.99)])).alias("x")).select("feature", "upto", "n", "x.*")
    rows = drift_ops.to_long(monitoring(spark, sf_dir)["prod"], DRIFT_FEATURES, ["month"]).where("value is not null")
    same = (F.col("month") <= F.col("upto")) & (F.col("feature") == F.col("f"))
    # found: two rows per feature and month
    rank = rows.join(F.broadcast(found.withColumnRenamed("feature", "f")), same).groupBy("feature", "upto", "q", "n").agg(
        F.count_if(F.col("value") < F.col("v")).alias("below"), F.count_if(F.col("value") <= F.col("v")).alias("upto_v"))
    off = F.greatest(F.col("below") - F.col("q") * F.col("n"), F.col("q") * F.col("n") - F.col("upto_v"), F.lit(0.0))
    return rank.select("feature", "upto", "q", F.col("n").cast("bigint").alias("n"),
                       (off <= drift_ops.SKETCH_RANK_ERROR * F.col("n") + 1).cast("int").alias("within"))


@register("psi_sketch")
def q_psi_sketch(spark, sf_dir):
    """PSI on edges from sketches: within a tenth (and 0.05) of the exact PSI."""
    m = monitoring(spark, sf_dir)
    ref = drift_ops.to_long(m["ref"], DRIFT_FEATURES)
    cur = drift_ops.to_long(m["prod"], DRIFT_FEATURES, ["month"])
    near = drift_ops.psi(ref, cur, "month", approx=True).withColumnRenamed("psi", "a")
    exact = psi_long(spark, sf_dir)
    close = F.abs(F.col("a") - F.col("psi")) <= F.lit(0.05) + F.col("psi") / 10
    return near.join(exact, ["feature", "month"]).select(
        "feature", "month", F.coalesce(close, F.col("a").isNull() & F.col("psi").isNull()).cast("int").alias("close"))


@register("psi_wide")
def q_psi_wide(spark, sf_dir):
    p = drift_ops.psi_with_severity(psi_long(spark, sf_dir)).withColumn("psi", snap("psi"))
    months = months_present(monitoring(spark, sf_dir)["prod"])
    w = (p.groupBy("feature").pivot("month", months)
         .agg(F.first("psi").alias("psi"), F.first("severity").alias("severity")))
    return w.select("feature", *[F.col(f"{m}_{k}").alias(f"{k}_m{m}")
                                 for m in months for k in ("psi", "severity")])


def ks_table(spark, sf_dir) -> DataFrame:
    m = monitoring(spark, sf_dir)
    ref = drift_ops.to_long(m["ref"], DRIFT_FEATURES)
    cur = drift_ops.to_long(m["prod"], DRIFT_FEATURES, ["month"])
    return drift_ops.ks(ref, cur, months_present(m["prod"]), "month").withColumn("p_value", snap("p_value"))


@register("ks_matrix")
def q_ks_matrix(spark, sf_dir):
    return ks_table(spark, sf_dir)


@register("ks_significant")
def q_ks_significant(spark, sf_dir):
    return ks_table(spark, sf_dir).where("significant = 1")


@register("monthly_profile")
def q_monthly_profile(spark, sf_dir):
    p = mon.monthly_profile(monitoring(spark, sf_dir)["prod"])
    return snapped(p, ["mean_delivery_days", "mean_total_freight_value", "electronics_share",
                       "positive_rate"])


def performance(spark, sf_dir) -> DataFrame:
    return mon.monthly_performance(monitoring(spark, sf_dir)["scored"])


@register("monthly_performance")
def q_monthly_performance(spark, sf_dir):
    return snapped(performance(spark, sf_dir), ["accuracy", "f1", "positive_rate", "auc"])


@register("performance_drop")
def q_performance_drop(spark, sf_dir):
    return snapped(mon.performance_drop(performance(spark, sf_dir)),
                   ["first_value", "last_value", "abs_drop", "pct_drop"])


@register("alerts")
def q_alerts(spark, sf_dir):
    a = mon.alerts(psi_long(spark, sf_dir), performance(spark, sf_dir))
    return a.withColumn("value", snap("value"))


@register("retrain_trigger")
def q_retrain_trigger(spark, sf_dir):
    t = mon.retrain_trigger(psi_long(spark, sf_dir), performance(spark, sf_dir))
    return snapped(t, ["rolling_f1", "baseline_f1"])


def _prod_view(spark, sf_dir) -> DataFrame:
    return monitoring(spark, sf_dir)["prod"]


@register("jitter_shift_scale")
def q_jitter_shift_scale(spark, sf_dir):
    return snapped(_prod_view(spark, sf_dir).select(KEY, "month", *NUMERIC_FEATURES),
                   NUMERIC_FEATURES)


@register("category_reassign")
def q_category_reassign(spark, sf_dir):
    return _prod_view(spark, sf_dir).select(KEY, "month", "product_category")


@register("label_flip")
def q_label_flip(spark, sf_dir):
    return _prod_view(spark, sf_dir).select(KEY, "month", LABEL)


@register("confusion_metrics")
def q_confusion_metrics(spark, sf_dir):
    s = monitoring(spark, sf_dir)["scored"]
    cm = met.confusion_metrics(s, "y_true", "y_pred", "month")
    return snapped(cm, ["accuracy", "precision_pos", "recall_pos", "f1_pos", "precision_neg",
                        "recall_neg", "f1_neg", "f1_macro"])


@register("roc_auc")
def q_roc_auc(spark, sf_dir):
    """Exact AUC per month and over all months (month NULL)."""
    s = monitoring(spark, sf_dir)["scored"]
    per = met.roc_auc(s, "y_true", "y_proba", "month")
    overall = met.roc_auc(s, "y_true", "y_proba").withColumn("month", F.lit(None).cast("int"))
    return snapped(per.unionByName(overall), ["auc"])


@register("threshold_sweep")
def q_threshold_sweep(spark, sf_dir):
    s = monitoring(spark, sf_dir)["scored"]
    t = met.threshold_sweep(s, "y_true", "y_proba")
    return snapped(t, ["accuracy", "precision_pos", "recall_pos", "f1_pos", "precision_neg",
                       "recall_neg", "f1_neg", "f1_macro"])


COSTS = {"cost_missed": 5.0, "cost_false": 1.0}  # an unhappy customer missed, a happy one called


@register("cost_curve")
def q_cost_curve(spark, sf_dir):
    """Cost of every threshold on P(negative), per month, with the cheapest marked."""
    return met.cost_curve(monitoring(spark, sf_dir)["scored"], "y_true", "y_proba", **COSTS, by="month")


@register("score_cost_threshold")
def q_score_cost_threshold(spark, sf_dir):
    """The reference's cheapest threshold, applied to the production rows."""
    m = monitoring(spark, sf_dir)
    curve = met.cost_curve(feature_model(spark, sf_dir)(m["ref"]), "y_true", "y_proba", **COSTS)
    step = curve.where("is_best = 1").agg(F.max("step")).scalar()
    called = F.least(F.floor((F.lit(1.0) - F.col("y_proba")) * 1000), F.lit(1000)) >= step
    return m["scored"].select(KEY, "month", (step / F.lit(1000.0)).alias("threshold"),
                              F.when(called, 0).otherwise(1).alias("y_pred"))


@register("ks_exact_months")
def q_ks_exact_months(spark, sf_dir):
    """Each month against the one before it: KS statistic with the exact p-value of
    small samples (up to 10,000 values), the asymptotic one beyond."""
    prod = monitoring(spark, sf_dir)["prod"].select("month", *DRIFT_FEATURES)
    cur = drift_ops.to_long(prod, DRIFT_FEATURES, ["month"])
    return drift_ops.ks_neighbours(cur, "month").withColumn("p_value", snap("p_value"))


@register("retrain_set")
def q_retrain_set(spark, sf_dir):
    """Reference rows faded by age (half-life 6 months, counted from the newest
    month of the data) + labelled months from 4 on."""
    return snapped(retraining_rows(spark, sf_dir), [*NUMERIC_FEATURES, "weight"])


def retraining_rows(spark, sf_dir, before=None) -> DataFrame:
    """The retraining set; with ``before``, of the months before that one only."""
    m = monitoring(spark, sf_dir)
    y0, m0 = int(FIRST_MONTH[:4]), int(FIRST_MONTH[5:7])
    months = m["all"] if before is None else m["all"].where(F.col("month") < before)
    newest = months.agg(F.max("month")).scalar() + (y0 * 12 + m0 - 1)
    ts = "order_purchase_timestamp"
    old = m["ref"].select(KEY, "month", LABEL, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES,
                          (newest - (F.year(ts) * 12 + F.month(ts))).cast("double").alias("age_months"))
    recent = m["prod"].where((F.col("month") >= 4) & (F.lit(before is None) | (F.col("month") < F.lit(before))))
    return mon.retraining_set(old, recent.select(
        KEY, "month", LABEL, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES), 6.0)


# --- step 8: text ----------------------------------------------------------

from orderpulse.functions.columns import preview, stars_label  # noqa: E402
from orderpulse.operators import text as txt  # noqa: E402

METRICS6 = ["accuracy", "precision_pos", "recall_pos", "f1_pos", "recall_neg", "f1_macro"]


def clean_documents(spark, sf_dir) -> DataFrame:
    """Document texts cleaned once: (doc_id, text, doc_n_chars)."""
    d = read_driver_tables(spark, sf_dir, ["documents"])["documents"]
    c = txt.clean_text(d.select("doc_id", F.col("text").alias("_raw"), "n_chars"), "_raw", "text")
    return c.select("doc_id", "text", F.col("n_chars").alias("doc_n_chars"))


def cleaned_reviews(spark, sf_dir, with_text=True, text_fn=None) -> DataFrame:
    """Reviews whose comment is non-empty after stripping, with the cleaned
    comment. Many reviews share one document text in the stand-in, so each
    distinct text is cleaned once (and optionally reduced by ``text_fn``)
    before the join; reviews with a whitespace-only comment go through the
    same cleaning (Catalyst folds it to an empty relation). Without
    ``with_text`` the wide text column never enters the join."""
    t = tables(spark, sf_dir)
    docs = read_driver_tables(spark, sf_dir, ["documents"])["documents"]
    refs = standin.comment_refs(t["order_reviews"], docs)
    cd = clean_documents(spark, sf_dir)
    if text_fn is not None:
        cd = cd.withColumn("text", text_fn(F.col("text")))
    if not with_text:
        cd = cd.drop("text")
    keys = ["review_id", "order_id", "review_score"]
    doc_rows = refs.where("kind = 'doc'").join(cd, "doc_id", "inner")
    ws = txt.clean_text(refs.where("kind = 'ws'").withColumn(
        "_raw", F.lit(standin.WHITESPACE_COMMENT)), "_raw", "text")
    if text_fn is not None:
        ws = ws.withColumn("text", text_fn(F.col("text")))
    ws = ws.withColumn("doc_n_chars", F.lit(None).cast("bigint"))
    cols = keys + ["doc_id"] + (["text"] if with_text else []) + ["doc_n_chars"]
    return doc_rows.select(*cols).unionByName(ws.select(*cols))


def text_predictions(spark, sf_dir) -> DataFrame:
    """Reviews with the text model's '<k> stars' and its confidence, each text
    scored by the model of the other folds. The predictions are one table of a
    row per document, written once and read by every query that uses them."""
    reviews = cleaned_reviews(spark, sf_dir, with_text=False)

    def build():
        docs = read_driver_tables(spark, sf_dir, ["documents"])["documents"].select("doc_id", "text")
        words = materialize(spark, "word_buckets", sf_dir, lambda: txt.fold_buckets(docs, seed=SEED))
        return txt.out_of_fold_stars(words, reviews.select("doc_id", "review_score"), seed=SEED)
    stars = materialize(spark, "star_predictions", sf_dir, build)
    c = reviews.join(stars.withColumnRenamed("pred_stars", "_k"), "doc_id")
    return txt.stars_to_binary(c.withColumn("text_label", stars_label("_k")).drop("_k"), "text_label")


@register("text_stars")
def q_text_stars(spark, sf_dir):
    """Out-of-fold star predictions of every review with a comment."""
    return text_predictions(spark, sf_dir).select(
        "review_id", "order_id", "text_label", "pred_stars", snap("text_score").alias("text_score"))


@register("text_clean")
def q_text_clean(spark, sf_dir):
    return cleaned_reviews(spark, sf_dir).select(
        "review_id", "order_id", "review_score", "text",
        F.length("text").cast("bigint").alias("n_chars"))


@register("text_sample_500")
def q_text_sample_500(spark, sf_dir):
    """500 reviews in hash order, chosen on keys; texts joined for those only."""
    keys = cleaned_reviews(spark, sf_dir, with_text=False)
    pick = sampling.sample_n(keys.select("review_id", "order_id", "review_score", "doc_id"),
                             500, "review_id", SEED)
    return pick.join(clean_documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "inner") \
        .select("review_id", "order_id", "review_score", "text")


@register("text_preview")
def q_text_preview(spark, sf_dir):
    c = cleaned_reviews(spark, sf_dir, text_fn=lambda t: preview(t, 60))
    return c.select("review_id", F.col("text").alias("preview"))


@register("stars_crosstab")
def q_stars_crosstab(spark, sf_dir):
    p = text_predictions(spark, sf_dir)
    ct = met.crosstab(p, "pred_stars", "review_score", [1, 2, 3, 4, 5])
    return ct.select("pred_stars", *[F.col(f"`{k}`").cast("bigint").alias(f"actual_{k}")
                                     for k in range(1, 6)])


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    """Text model vs feature model on the same held-out reviews.

    Truth is the review's own score (>= 4); reviews of training orders are
    excluded (anti-join on the split), unlike the original, which scored
    rows the model had trained on.
    """
    p = text_predictions(spark, sf_dir).withColumn("y_true", F.expr("CAST(review_score >= 4 AS INT)"))
    split = sampling.stratified_split(features(spark, sf_dir).select(KEY, LABEL), LABEL, KEY,
                                      0.2, SEED)
    p = p.join(split.where("split = 'train'").select(KEY), KEY, "left_anti")
    f = feature_model(spark, sf_dir)(features(spark, sf_dir)).select(KEY, F.col("y_pred").alias("f_pred"))
    j = p.join(f, KEY, "inner")
    a = snapped(met.confusion_metrics(j, "y_true", "pred_binary"), METRICS6)
    b = snapped(met.confusion_metrics(j, "y_true", "f_pred"), METRICS6)
    return met.compare_models(a, b, "text_model", "feature_model", METRICS6)


@register("route_queue")
def q_route_queue(spark, sf_dir):
    f = feature_model(spark, sf_dir)(features(spark, sf_dir)).select(KEY, "y_proba")
    return snapped(txt.route(f, text_predictions(spark, sf_dir)), ["score"])


@register("score_text")
def q_score_text(spark, sf_dir):
    """Native text model trained on labelled documents (quality), applied to
    every cleaned review comment (whole texts)."""
    t = read_driver_tables(spark, sf_dir, ["documents", "labels"])
    train = (t["documents"].join(t["labels"], "doc_id", "inner")
             .select("text", F.col("quality").cast("double").alias("label")))
    model = txt.fit_text_model(train, "text", "label")
    # every distinct cleaned text is scored once, then joined to its reviews
    scored = txt.score_text(model, clean_documents(spark, sf_dir), "text") \
        .select("doc_id", "text_label", "text_score")
    docs = read_driver_tables(spark, sf_dir, ["documents"])["documents"]
    refs = standin.comment_refs(tables(spark, sf_dir)["order_reviews"], docs)
    return refs.where("kind = 'doc'").join(scored, "doc_id", "inner") \
        .select("review_id", "order_id", "text_label", "text_score")


# --- step 6: validation ------------------------------------------------------

from orderpulse import ALL_FEATURES  # noqa: E402
from orderpulse.operators import models as mdl  # noqa: E402
from orderpulse.operators import validate as val  # noqa: E402


def allowed_from_training(spark, sf_dir) -> DataFrame:
    """Allowed values = categories seen in the training split, plus 'missing'.

    Written once per session (a few rows), so micro-batches and validation
    queries read a tiny table instead of re-scanning the features."""
    def build():
        f = sampling.stratified_split(features(spark, sf_dir), LABEL, KEY, 0.2, SEED)
        return val.allowed_from_data(f.where("split = 'train'"))
    return materialize(spark, "allowed_values", sf_dir, build)


def json_records(f: DataFrame, malformed: bool = True) -> DataFrame:
    """One JSON object per order with faults injected by ``order_id % 13``:
    1 field absent, 2 text for a number, 3 boolean for a number, 4 negative
    price, 5 negative delivery_vs_estimated (valid), 6 number for a
    category, 7 unknown state, 8 empty payment type, 9 extra field
    (ignored), 10 explicit null, 11 array instead of object, 12 malformed."""
    def js(over=None, drop=None, keep_nulls=False):
        d = {c: F.col(c) for c in ALL_FEATURES}
        if drop:
            d.pop(drop)
        d.update(over or {})
        st = F.struct(*[v.alias(n) for n, v in d.items()])
        return F.to_json(st, {"ignoreNullFields": "false"}) if keep_nulls else F.to_json(st)
    k = F.col(KEY) % 13
    body = (F.when(k == 1, js(drop="total_order_value"))
            .when(k == 2, js({"total_order_value": F.lit("not a number")}))
            .when(k == 3, js({"delivery_days": F.lit(True)}))
            .when(k == 4, js({"avg_product_price": F.lit(-1.5)}))
            .when(k == 5, js({"delivery_vs_estimated": F.lit(-5.0)}))
            .when(k == 6, js({"product_category": F.lit(42)}))
            .when(k == 7, js({"seller_state": F.lit("ZZ")}))
            .when(k == 8, js({"payment_type": F.lit("")}))
            .when(k == 9, js({"note": F.lit("x")}))
            .when(k == 10, js({"min_product_photos_qty": F.lit(None).cast("double")}, keep_nulls=True))
            .when(k == 11, F.concat(F.lit("["), js(), F.lit("]"))))
    if malformed:
        body = body.when(k == 12, F.regexp_replace(js(), "}$", ""))
    return f.select(KEY, body.otherwise(js()).alias("body"))


@register("validate_rows")
def q_validate_rows(spark, sf_dir):
    v = val.validate_rows(features(spark, sf_dir), allowed_from_training(spark, sf_dir))
    return v.select(KEY, "is_valid", val.canonical_errors("errors").alias("errors"))


@register("validation_summary")
def q_validation_summary(spark, sf_dir):
    v = val.validate_rows(features(spark, sf_dir), allowed_from_training(spark, sf_dir))
    return val.error_summary(v)


@register("validate_json_records")
def q_validate_json_records(spark, sf_dir):
    recs = json_records(features(spark, sf_dir))
    v = val.validate_json(recs, "body", allowed_from_training(spark, sf_dir))
    return v.select(KEY, "is_valid", val.canonical_errors("errors").alias("errors"))


def json_batches(f: DataFrame, size: int = 100) -> DataFrame:
    """Orders grouped into arrays of at most ``size`` records by key range
    (bounded groups), with batch faults by ``batch_id % 10``: 7 empty array,
    8 an object, 9 the array repeated twice (over the limit when > 50)."""
    recs = json_records(f, malformed=False).withColumn("batch_id", F.floor(F.col(KEY) / size))
    arr = recs.groupBy("batch_id").agg(
        F.concat_ws(",", F.sort_array(F.collect_list(F.struct(KEY, "body")))["body"]).alias("_items"))
    b = F.col("batch_id") % 10
    body = (F.when(b == 7, F.lit("[]"))
            .when(b == 8, F.lit('{"orders": []}'))
            .when(b == 9, F.concat(F.lit("["), F.col("_items"), F.lit(","), F.col("_items"),
                                   F.lit("]")))
            .otherwise(F.concat(F.lit("["), F.col("_items"), F.lit("]"))))
    return arr.select("batch_id", body.alias("body"))


@register("validate_json_batches")
def q_validate_json_batches(spark, sf_dir):
    bodies = json_batches(features(spark, sf_dir))
    v = val.validate_json_batches(bodies, "batch_id", "body", allowed_from_training(spark, sf_dir))
    return v.select("batch_id", "pos", "status", "body_error",
                    val.canonical_errors("errors").alias("errors"))


def quarantined_batches(spark, sf_dir) -> DataFrame:
    """Batches whose broken records alone are rejected."""
    return val.validate_json_batches(json_batches(features(spark, sf_dir)), "batch_id", "body",
                                     allowed_from_training(spark, sf_dir), mode="quarantine_rows")


@register("batch_error_report")
def q_batch_error_report(spark, sf_dir):
    """The error body of every rejected batch: ``record_i`` with its fields' messages."""
    v = val.validate_json_batches(json_batches(features(spark, sf_dir)), "batch_id", "body",
                                  allowed_from_training(spark, sf_dir))
    entries = F.transform(F.map_entries("details"), lambda e: F.struct(
        e["key"].alias("name"), val.canonical_errors(e["value"]).alias("text")))
    line = F.transform(F.array_sort(entries), lambda x: F.concat(x["name"], F.lit(": "), x["text"]))
    return val.batch_error_report(v, "batch_id").select(
        "batch_id", F.size("details").alias("n_records"), F.array_join(line, " | ").alias("report"))


@register("quarantine_rows")
def q_quarantine_rows(spark, sf_dir):
    return quarantined_batches(spark, sf_dir).select(
        "batch_id", "pos", "status", "body_error", val.canonical_errors("errors").alias("errors"))


@register("batch_responses")
def q_batch_responses(spark, sf_dir):
    """Answers to every batch's accepted records, in the order they came in."""
    good = quarantined_batches(spark, sf_dir).where("status = 'accepted'").withColumn(LABEL, F.lit(None).cast("int"))
    r = mdl.batch_responses(feature_model(spark, sf_dir)(good), "batch_id")
    return r.select("batch_id", F.size("predictions").alias("n"),
                    F.array_join(F.transform("predictions", lambda p: p["label"]), ",").alias("labels"),
                    F.array_join(F.transform("predictions", lambda p: F.format_number(p["probability"], 4)), ",")
                    .alias("probabilities"))


# --- step 7: preprocessing, models, scoring, runs ---------------------------

from orderpulse.operators import preprocess as pre  # noqa: E402


def split_features(spark, sf_dir) -> DataFrame:
    return sampling.stratified_split(features(spark, sf_dir), LABEL, KEY, 0.2, SEED)


@register("impute_scale")
def q_impute_scale(spark, sf_dir):
    """Exact-median impute + population-std scale, fitted on the training
    split and applied to every row."""
    f = split_features(spark, sf_dir)
    m = pre.MedianStandardizer(inputCols=NUMERIC_FEATURES, outputCols=NUMERIC_FEATURES) \
        .fit(f.where("split = 'train'"))
    return snapped(m.transform(f).select(KEY, *NUMERIC_FEATURES), NUMERIC_FEATURES)


@register("onehot_missing")
def q_onehot_missing(spark, sf_dir):
    """One-hot slot of each categorical (alphabetical index of the training
    categories, 'missing' for NULL); unseen values -> NULL (all-zero vector)."""
    from pyspark.ml import Pipeline
    f = split_features(spark, sf_dir)
    filled = [f"{c}__filled" for c in CATEGORICAL_FEATURES]
    idx = [f"{c}__idx" for c in CATEGORICAL_FEATURES]
    stages = pre.build_preprocessor()[1:4]
    model = Pipeline(stages=stages).fit(f.where("split = 'train'"))
    out = model.transform(f)
    sizes = {c: len(lbl) for c, lbl in zip(CATEGORICAL_FEATURES, model.stages[1].labelsArray)}
    return out.select(KEY, *[
        F.when(F.col(i) < sizes[c], F.col(i).cast("int")).alias(f"{c}_slot")
        for c, i in zip(CATEGORICAL_FEATURES, idx)] + [
        F.lit(sizes[c]).alias(f"{c}_size") for c in CATEGORICAL_FEATURES]).drop(*filled)


def trained(spark, sf_dir, spec: dict, name: str):
    """Fit once per session on the training split; saved in the model store."""
    def build():
        f = split_features(spark, sf_dir)
        return mdl.train_and_log(
            spark, f.where("split = 'train'"), f.where("split = 'test'"), spec, name,
            stage_path(spark, "runs", sf_dir), stage_path(spark, f"model_{name}", sf_dir))
    return memo(spark, f"model_{name}", sf_dir, build)


def retrained(spark, sf_dir):
    """Boosting on the retraining set's weights, without the test split's orders."""
    def build():
        split = split_features(spark, sf_dir)
        rows = retraining_rows(spark, sf_dir).join(
            split.where("split = 'train'").select(KEY), KEY, "left_semi")
        return mdl.train_and_log(
            spark, rows, split.where("split = 'test'"), mdl.BOOSTING, "boosting_retrained",
            stage_path(spark, "runs", sf_dir), stage_path(spark, "model_boosting_retrained", sf_dir),
            {"weights": "half-life 6 months"}, weight_col="weight")
    return memo(spark, "model_boosting_retrained", sf_dir, build)


@register("train_forest")
def q_train_forest(spark, sf_dir):
    _, metrics = trained(spark, sf_dir, mdl.FOREST, "forest")
    return metrics.withColumn("model", F.lit("forest"))


@register("train_boosting")
def q_train_boosting(spark, sf_dir):
    _, metrics = trained(spark, sf_dir, mdl.BOOSTING, "boosting")
    return metrics.withColumn("model", F.lit("boosting"))


@register("score_batch")
def q_score_batch(spark, sf_dir):
    """Score the held-out orders with the boosting model; response structs."""
    model, _ = trained(spark, sf_dir, mdl.BOOSTING, "boosting")
    test = split_features(spark, sf_dir).where("split = 'test'")
    s = mdl.response(mdl.score(model, test))
    return s.select(KEY, "response.*", F.to_json("response").alias("response_json"))


@register("run_leaderboard")
def q_run_leaderboard(spark, sf_dir):
    trained(spark, sf_dir, mdl.FOREST, "forest")
    trained(spark, sf_dir, mdl.BOOSTING, "boosting")
    retrained(spark, sf_dir)
    runs = spark.read.parquet(stage_path(spark, "runs", sf_dir))
    return mdl.leaderboard(runs, "roc_auc")


# --- step 9: streaming ---------------------------------------------------------

import uuid as _uuid  # noqa: E402

from orderpulse.streaming import jobs as st  # noqa: E402

EVENT_SCHEMA = "order_id bigint, event_ts timestamp, event_type string, value double, user_id bigint"
SCORED_SCHEMA = "order_id bigint, event_ts timestamp, y_proba double, y_pred int"
QUARANTINE_SCHEMA = "order_id bigint, event_ts timestamp, errors string"
WINDOW_SCHEMA = ("window_start timestamp, event_type string, n bigint, mean_value double, "
                 "min_value double, max_value double")
BIN_SCHEMA = "window_start timestamp, bin int, n bigint"


def _stream_dir(spark, sf_dir, name) -> str:
    """A fresh folder (sinks, checkpoints) under the shared checkpoint dir."""
    return stage_path(spark, f"{name}-{_uuid.uuid4().hex[:8]}", sf_dir)


def _events(spark, sf_dir) -> DataFrame:
    return read_driver_tables(spark, sf_dir, ["events"])["events"]


def event_stream(spark, sf_dir) -> DataFrame:
    """The events table as a stream (``order_id = event_id``; watermarks refuse
    TIMESTAMP_NTZ)."""
    # a pattern, because a stream takes a folder or a pattern but not the path of one file
    raw = st.file_stream(spark, f"{sf_dir.rstrip('/')}/event[s].parquet", _events(spark, sf_dir).schema, None)
    return raw.select(F.col("event_id").alias("order_id"), F.col("ts").cast("timestamp").alias(st.EVENT_TS),
                      "event_type", "value", "user_id")


def redelivered(spark, sf_dir) -> DataFrame:
    """The event stream with an eighth of the events delivered twice."""
    return event_stream(spark, sf_dir).union(event_stream(spark, sf_dir).where(F.col(KEY) % 8 == 7))


def read_sink(spark, path: str, schema: str) -> DataFrame:
    """A sink's rows; none when nothing was written."""
    return spark.read.schema(schema).parquet(path)


@register("stream_score")
def q_stream_score(spark, sf_dir):
    """Events (some delivered twice) -> dedup -> features -> validate ->
    score / quarantine, idempotent per micro-batch."""
    base = _stream_dir(spark, sf_dir, "stream_score")
    feats = features(spark, sf_dir).drop("order_purchase_timestamp")
    q = st.stream_score(redelivered(spark, sf_dir), feats, allowed_from_training(spark, sf_dir),
                        feature_model(spark, sf_dir), f"{base}/scored", f"{base}/quarantine", f"{base}/_ckpt")
    st.run_available_now(q)
    good = read_sink(spark, f"{base}/scored", SCORED_SCHEMA).select(
        KEY, F.lit("scored").alias("status"), snap("y_proba").alias("y_proba"), "y_pred",
        F.lit(None).cast("string").alias("errors"))
    bad = read_sink(spark, f"{base}/quarantine", QUARANTINE_SCHEMA).select(
        KEY, F.lit("quarantined").alias("status"), F.lit(None).cast("double").alias("y_proba"),
        F.lit(None).cast("int").alias("y_pred"), "errors")
    return good.unionByName(bad)


@register("stream_window_stats")
def q_stream_window_stats(spark, sf_dir):
    base = _stream_dir(spark, sf_dir, "stream_window_stats")
    src = event_stream(spark, sf_dir)
    st.run_available_now(st.stream_window_stats(src, f"{base}/out", f"{base}/_ckpt"))
    out = st.latest_per_key(spark, f"{base}/out", ["window_start", "event_type"], WINDOW_SCHEMA)
    return out.select(F.to_date("window_start").alias("window_day"), "event_type",
                      F.col("n").cast("bigint").alias("n"), snap("mean_value").alias("mean_value"),
                      "min_value", "max_value")


def _event_reference(spark, sf_dir) -> DataFrame:
    """Reference values: events of the first 7 days (long form)."""
    ev = _events(spark, sf_dir)
    start = ev.agg(F.min("ts")).scalar()
    ref = ev.where(F.col("ts") < start + F.expr("INTERVAL 7 DAYS"))
    return drift_ops.to_long(ref, ["value"])


@register("stream_drift")
def q_stream_drift(spark, sf_dir):
    """Daily PSI of event values against fixed edges from the first week."""
    base = _stream_dir(spark, sf_dir, "stream_drift")
    ref = _event_reference(spark, sf_dir).where(F.col("value").isNotNull())
    edges = drift_ops.reference_edges(ref)
    rc = (ref.join(F.broadcast(edges.select("feature", "edges")), "feature")
          .withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("value"))))
          .groupBy("bin").count())
    # total as a scalar subquery: no single-partition window
    shares = rc.select("bin", (F.col("count") / rc.agg(F.sum("count")).scalar()).alias("r_share"))
    st.run_available_now(st.stream_drift(event_stream(spark, sf_dir), edges, f"{base}/out", f"{base}/_ckpt"))
    counts = st.latest_per_key(spark, f"{base}/out", ["window_start", "bin"], BIN_SCHEMA)
    p = st.psi_from_counts(counts, shares)
    return p.select(F.to_date("window_start").alias("window_day"),
                    snap("psi").alias("psi"), drift_ops.severity("psi").alias("severity"))


@register("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    base = _stream_dir(spark, sf_dir, "stream_dedup")
    st.run_available_now(st.stream_dedup(redelivered(spark, sf_dir), f"{base}/out", f"{base}/_ckpt"))
    return read_sink(spark, f"{base}/out", EVENT_SCHEMA).select(
        KEY, F.unix_micros(st.EVENT_TS).alias("event_us"), "event_type", "value", "user_id")


def scored_orders(spark, sf_dir) -> DataFrame:
    """The feature model's answer for every order, written once: a stream joins it in
    every micro-batch, and would read and score all features again each time."""
    return materialize(spark, "scored_orders", sf_dir, lambda: feature_model(spark, sf_dir)(
        features(spark, sf_dir)).select(KEY, "y_proba", "y_pred"))


@register("stream_label_join")
def q_stream_label_join(spark, sf_dir):
    """Predictions at event time joined to reviews arriving 0-119 hours
    later (kept when within 4 days)."""
    base = _stream_dir(spark, sf_dir, "stream_label_join")
    rv = tables(spark, sf_dir)["order_reviews"].select(KEY, "review_id", "review_score")
    delay = F.make_dt_interval(F.lit(0), ((F.col("review_id") * 7) % 120).cast("int"))
    labels = event_stream(spark, sf_dir).select(KEY, st.EVENT_TS).join(rv, KEY, "inner").select(
        KEY, "review_id", "review_score", (F.col(st.EVENT_TS) + delay).alias("review_ts"))
    scored = scored_orders(spark, sf_dir)
    preds = (event_stream(spark, sf_dir).join(scored, KEY, "inner")
             .select(KEY, F.col(st.EVENT_TS).alias("scored_ts"), "y_proba", "y_pred"))
    st.run_available_now(st.stream_label_join(preds, labels, f"{base}/out", f"{base}/_ckpt"))
    out = read_sink(spark, f"{base}/out", f"{KEY} bigint, scored_ts timestamp, review_ts timestamp, "
                    "y_proba double, y_pred int, review_id bigint, review_score int, y_true int")
    return out.select(KEY, "review_id", snap("y_proba").alias("y_proba"), "y_pred", "review_score",
                      "y_true", ((F.unix_micros("review_ts") - F.unix_micros("scored_ts"))
                                 / 3600000000).cast("int").alias("lag_hours"))


def feed_rows(spark, sf_dir) -> DataFrame:
    ev = _events(spark, sf_dir)
    return ev.select(F.col("event_id").alias(KEY), F.col("ts").cast("timestamp").alias(st.EVENT_TS),
                     "event_type", "value", "user_id")


def feed(spark, sf_dir, with_late: bool) -> DataFrame:
    """The events as a feed in time order, a range per micro-batch. ``with_late``:
    a sixteenth of the first two days' events comes after everything else."""
    def land() -> str:
        path = _stream_dir(spark, sf_dir, "feed")
        rows = feed_rows(spark, sf_dir)
        first = rows.agg(F.min(st.EVENT_TS)).scalar()
        late = (F.col(KEY) % 16 == 5) & (F.col(st.EVENT_TS) < first + F.expr("INTERVAL 2 DAYS"))
        late = F.lit(with_late) & F.coalesce(late, F.lit(False))
        st.land_feed(rows.where(~late), path, late=rows.where(late) if with_late else None)
        return path
    path = memo(spark, f"feed-{with_late}", sf_dir, land)
    return st.file_stream(spark, path, EVENT_SCHEMA, 1)


def windows_run(spark, sf_dir) -> str:
    """One run over the feed with late rows: final windows and the progress table."""
    def run() -> str:
        base, name = _stream_dir(spark, sf_dir, "stream_windows_final"), f"windows-{_uuid.uuid4().hex[:8]}"
        with st.progress_logged(spark, f"{base}/progress", name):
            st.run_available_now(st.stream_windows_final(
                feed(spark, sf_dir, True), f"{base}/out", f"{base}/_ckpt", name=name))
        return base
    return memo(spark, "windows_run", sf_dir, run)


@register("stream_windows_final")
def q_stream_windows_final(spark, sf_dir):
    """Daily windows, each written once when it is final; late events are left out."""
    out = read_sink(spark, f"{windows_run(spark, sf_dir)}/out", WINDOW_SCHEMA)
    return out.select(F.to_date("window_start").alias("window_day"), "event_type",
                      F.col("n").cast("bigint").alias("n"), snap("mean_value").alias("mean_value"),
                      "min_value", "max_value")


@register("stream_late_rows")
def q_stream_late_rows(spark, sf_dir):
    """Rows dropped as late by every progress report, against the rows the windows lack."""
    base = windows_run(spark, sf_dir)
    log = spark.read.schema(st.PROGRESS).parquet(f"{base}/progress")
    out = read_sink(spark, f"{base}/out", WINDOW_SCHEMA)
    delivered = _events(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    kept = out.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return log.agg(F.coalesce(F.sum("n_late"), F.lit(0)).alias("n_late")).select(
        "n_late", (delivered - kept).alias("n_missing"))


def _event_reference_by_type(spark, sf_dir) -> DataFrame:
    """(feature, edges, shares) of the first 7 days' values of each event type. Written
    once: every micro-batch reads it twice, and would sort the values again each time."""
    def build():
        ev = _events(spark, sf_dir)
        start = ev.agg(F.min("ts")).scalar()
        ref = ev.where(F.col("ts") < start + F.expr("INTERVAL 7 DAYS")).select(
            F.col("event_type").alias("feature"), F.col("value").cast("double").alias("value"))
        ref = ref.where(F.col("value").isNotNull() & ~F.isnan("value"))
        return drift_ops.reference_bins(ref, drift_ops.reference_edges(ref))
    return materialize(spark, "event_reference", sf_dir, build)


@register("stream_psi_alerts")
def q_stream_psi_alerts(spark, sf_dir):
    """PSI, severity and the run of RED days per event type, from state in the stream."""
    base = _stream_dir(spark, sf_dir, "stream_psi")
    st.run_available_now(st.stream_psi(
        feed(spark, sf_dir, False), _event_reference_by_type(spark, sf_dir), f"{base}/out", f"{base}/_ckpt",
        feature="event_type", name=f"psi-{_uuid.uuid4().hex[:8]}"))
    out = read_sink(spark, f"{base}/out", st.DRIFT_SCHEMA)
    return out.select(F.to_date("window_start").alias("window_day"), "feature", "n", snap("psi").alias("psi"),
                      drift_ops.severity("psi").alias("severity"), "red_run",
                      (F.col("red_run") >= 2).cast("int").alias("retrain"))


@register("stream_label_left")
def q_stream_label_left(spark, sf_dir):
    """Every prediction with the reviews of the next 4 days, or without a label once those are over."""
    base = _stream_dir(spark, sf_dir, "stream_label_left")
    rv = tables(spark, sf_dir)["order_reviews"].select(KEY, "review_id", "review_score")
    delay = F.make_dt_interval(F.lit(0), ((F.coalesce("review_id", F.lit(0)) * 7) % 120).cast("int"))
    closing = F.col(KEY).isNull()
    labels = (feed(spark, sf_dir, False).select(KEY, st.EVENT_TS).join(rv, KEY, "left")
              .where(F.col("review_id").isNotNull() | closing)
              .select(KEY, "review_id", "review_score", (F.col(st.EVENT_TS) + delay).alias("review_ts")))
    scored = scored_orders(spark, sf_dir)
    preds = (feed(spark, sf_dir, False).join(scored, KEY, "left").where(F.col("y_pred").isNotNull() | closing)
             .select(KEY, F.col(st.EVENT_TS).alias("scored_ts"), "y_proba", "y_pred"))
    st.run_available_now(st.stream_label_join(preds, labels, f"{base}/out", f"{base}/_ckpt",
                                              how="leftOuter", name=f"left-{_uuid.uuid4().hex[:8]}"))
    out = read_sink(spark, f"{base}/out", f"{KEY} bigint, scored_ts timestamp, review_ts timestamp, "
                    "y_proba double, y_pred int, review_id bigint, review_score int, y_true int")
    return out.select(KEY, "review_id", snap("y_proba").alias("y_proba"), "y_pred", "review_score",
                      "y_true", ((F.unix_micros("review_ts") - F.unix_micros("scored_ts"))
                                 / 3600000000).cast("int").alias("lag_hours"))


@register("stream_score_model")
def q_stream_score_model(spark, sf_dir):
    """Events scored with the boosting model loaded from the store by version,
    compared row by row with scoring the feature table as a batch."""
    base = _stream_dir(spark, sf_dir, "stream_score_model")
    model, _ = trained(spark, sf_dir, mdl.BOOSTING, "boosting")
    mdl.publish(spark, model, f"{base}/store")
    feats = features(spark, sf_dir).drop("order_purchase_timestamp")
    st.run_available_now(st.stream_score_model(
        feed(spark, sf_dir, False), feats, allowed_from_training(spark, sf_dir), f"{base}/store",
        f"{base}/scored", f"{base}/quarantine", f"{base}/_ckpt"))
    batch = mdl.score(model, feats).select(KEY, F.col("y_proba").alias("p"), F.col("y_pred").alias("c"))
    same = F.col("y_proba").eqNullSafe(F.col("p")) & F.col("y_pred").eqNullSafe(F.col("c"))
    good = read_sink(spark, f"{base}/scored", SCORED_SCHEMA + ", model_version int").join(batch, KEY, "left").select(
        KEY, F.lit("scored").alias("status"), "model_version", same.cast("int").alias("same_as_batch"),
        F.lit(None).cast("string").alias("errors"))
    bad = read_sink(spark, f"{base}/quarantine", QUARANTINE_SCHEMA).select(
        KEY, F.lit("quarantined").alias("status"), F.lit(None).cast("int").alias("model_version"),
        F.lit(None).cast("int").alias("same_as_batch"), "errors")
    return good.unionByName(bad)


# --- shapes and sample alignment -------------------------------------------------

from orderpulse.sources.tables import (  # noqa: E402
    ORDER_SCHEMAS, TIMESTAMP_COLUMNS, land_csv, land_observed, read_landed, shape_report)


@register("table_shapes")
def q_table_shapes(spark, sf_dir):
    """Row and column counts of the order tables (one aggregate each)."""
    return shape_report(tables(spark, sf_dir))


@register("landed_shapes")
def q_landed_shapes(spark, sf_dir):
    """The shapes of the order tables, counted by the jobs that land them."""
    return land_observed(tables(spark, sf_dir), _stream_dir(spark, sf_dir, "landed"))[1]


def broken_csv(spark, sf_dir, base: str) -> None:
    """CSV copies of the order items and orders as they could arrive: some prices are
    texts, some lines are cut, some timestamps are none."""
    t = tables(spark, sf_dir)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    k = F.col(KEY) * 7 + F.col("order_item_id")
    whole = F.concat_ws(",", text(KEY), text("order_item_id"), text("product_id"), text("seller_id"),
                        F.when(k % 101 == 3, F.lit("n/a")).otherwise(text("price")), text("freight_value"))
    line = F.when(k % 103 == 5, F.concat_ws(",", text(KEY), text("order_item_id"))).otherwise(whole)
    t["order_items"].select(line.alias("value")).write.text(f"{base}/order_items")
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    cols = [f.name for f in ORDER_SCHEMAS["orders"].fields]
    at = [F.when((F.col(KEY) % 97 == 5) & F.lit(c == "order_purchase_timestamp"), F.lit("soon")).otherwise(stamp(c))
          if c in TIMESTAMP_COLUMNS else (text(c) if c in t["orders"].columns else F.lit("")) for c in cols]
    t["orders"].select(F.concat_ws(",", *at).alias("value")).write.text(f"{base}/orders")


@register("csv_landing")
def q_csv_landing(spark, sf_dir):
    """Good and broken lines of the CSV copies, landed in two runs: the second finds
    nothing new. Timestamps that are none become NULL and stay."""
    base = _stream_dir(spark, sf_dir, "csv")
    broken_csv(spark, sf_dir, f"{base}/in")
    parts = []
    for name in ("order_items", "orders"):
        land_csv(spark, f"{base}/in/{name}", name, f"{base}/out", header=False)
        again = land_csv(spark, f"{base}/in/{name}", name, f"{base}/out", header=False)
        good, bad = read_landed(spark, f"{base}/out", name)
        null_ts = F.count_if(F.col("order_purchase_timestamp").isNull()) if name == "orders" else F.lit(0)
        counted = good.agg(F.count(F.lit(1)).alias("n_good"), null_ts.cast("bigint").alias("n_null_timestamps"))
        parts.append(counted.select(
            F.lit(name).alias("table"), "n_good", bad.agg(F.count(F.lit(1))).scalar().alias("n_bad"),
            "n_null_timestamps", again.agg(F.count(F.lit(1))).scalar().alias("n_files_again")))
    return parts[0].unionByName(parts[1])


@register("text_sample_features")
def q_text_sample_features(spark, sf_dir):
    """The 500 sampled reviews left-joined to their orders' features, with
    the review's own binary truth and a matched flag."""
    keys = cleaned_reviews(spark, sf_dir, with_text=False)
    pick = sampling.sample_n(keys.select("review_id", "order_id", "review_score"),
                             500, "review_id", SEED)
    f = features(spark, sf_dir).drop("order_purchase_timestamp", "review_score", LABEL)
    j = pick.join(f.withColumn("_m", F.lit(1)), KEY, "left")
    out = j.select("review_id", KEY, F.expr("CAST(review_score >= 4 AS INT)").alias("actual_binary"),
                   F.coalesce("_m", F.lit(0)).alias("matched"), *NUMERIC_FEATURES,
                   *CATEGORICAL_FEATURES)
    return snapped(out, ["total_order_value", "avg_product_price", "total_freight_value",
                         "avg_freight_value"])


@register("sample_feature_rows")
def q_sample_feature_rows(spark, sf_dir):
    """Feature rows of the orders whose reviews are in the 500-review sample
    (semi join on the sampled keys)."""
    keys = cleaned_reviews(spark, sf_dir, with_text=False)
    pick = sampling.sample_n(keys.select("review_id", KEY), 500, "review_id", SEED)
    f = features(spark, sf_dir).join(pick, KEY, "left_semi")
    return snapped(f.select(KEY, LABEL, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES),
                   ["total_order_value", "avg_product_price", "total_freight_value", "avg_freight_value"])


@register("comment_share")
def q_comment_share(spark, sf_dir):
    """Reviews, reviews with a comment, and their share."""
    docs = read_driver_tables(spark, sf_dir, ["documents"])["documents"]
    refs = standin.comment_refs(tables(spark, sf_dir)["order_reviews"], docs)
    has = refs.join(docs.select("doc_id", F.col("text").isNotNull().alias("_t")), "doc_id", "left")
    n = F.count_if((F.col("kind") == "ws") | ((F.col("kind") == "doc") & F.coalesce("_t", F.lit(False))))
    out = has.agg(F.count(F.lit(1)).alias("n_reviews"), n.alias("n_comments"))
    return out.withColumn("comment_share", snap(F.col("n_comments") / F.col("n_reviews")))


@register("monthly_performance_model")
def q_monthly_performance_model(spark, sf_dir):
    """Monthly accuracy / F1 / AUC of the trained boosting model on the
    drifted production months (the reference's D7 with a real model)."""
    model, _ = trained(spark, sf_dir, mdl.BOOSTING, "boosting")
    prod = monitoring(spark, sf_dir)["prod"]
    s = mdl.score(model, prod).withColumn("y_true", F.col(LABEL))
    return snapped(mon.monthly_performance(s), ["accuracy", "f1", "positive_rate", "auc"])
