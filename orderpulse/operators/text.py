"""Review text: cleaning, star labels, text scoring, routing.

Cleaning and label parsing are column expressions. Scoring has three forms:

* :func:`fit_text_model` / :func:`score_text` - a Spark ML pipeline
  (tokenizer, hashing TF, IDF, logistic regression) trained on labelled
  text; it runs on executors like any other transformer and reads whole
  texts (no truncation).
* :func:`out_of_fold_stars` - five classes of stars from a review's words, every
  text scored by a model that has not seen its own ratings.
* :func:`score_text_batches` - a user-supplied scorer applied with
  ``mapInPandas`` in Arrow batches, the model loaded once per Python worker
  (for external models that Spark cannot express).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderpulse.functions.columns import binarize, hash_uniform, parse_stars, strip_unicode


def clean_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Drop NULL texts, strip Unicode whitespace, drop texts empty after it."""
    out = out or col
    return (df.where(F.col(col).isNotNull())
            .withColumn(out, strip_unicode(col))
            .where(F.length(out) > 0))


def stars_to_binary(df: DataFrame, label_col: str, out_stars: str = "pred_stars",
                    out_binary: str = "pred_binary", cutoff: int = 4) -> DataFrame:
    """'4 stars' -> 4 -> 1 (>= cutoff positive)."""
    return (df.withColumn(out_stars, parse_stars(label_col))
            .withColumn(out_binary, binarize(out_stars, cutoff)))


def fit_text_model(df: DataFrame, text: str, label: str, num_features: int = 1 << 16,
                   max_iter: int = 50, reg: float = 0.01) -> PipelineModel:
    """Tokenize on non-word characters (Unicode aware), hashed TF-IDF, LR.

    The featurizer is fitted once and its output cached for the regression's
    iterations (a plain Pipeline would tokenize the corpus twice).
    """
    tok = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"(?U)\W+",
                         toLowercase=True, minTokenLength=1)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=1)
    feat = Pipeline(stages=[tok, tf, idf]).fit(df)
    data = feat.transform(df).select("_tfidf", label).cache()
    try:
        lr = LogisticRegression(featuresCol="_tfidf", labelCol=label, maxIter=max_iter,
                                regParam=reg, predictionCol="_pred", probabilityCol="_prob",
                                rawPredictionCol="_raw").fit(data)
    finally:
        data.unpersist()
    return PipelineModel(stages=[*feat.stages, lr])


def score_text(model: PipelineModel, df: DataFrame, text: str,
               positive: str = "positive", negative: str = "negative") -> DataFrame:
    """Adds ``text_label`` and ``text_score`` (confidence of that label)."""
    s = model.transform(df)
    prob = vector_to_array("_prob")
    return (s.withColumn("text_label", F.when(F.col("_pred") == 1, F.lit(positive))
                         .otherwise(F.lit(negative)))
            .withColumn("text_score", F.array_max(prob))
            .withColumn("text_p_positive", prob[1])
            .drop("_tokens", "_tf", "_tfidf", "_raw", "_prob", "_pred"))


STAR_BUCKETS = 65_536


def word_buckets(text) -> Column:
    """Distinct words (runs of letters and digits, A-Z lower-cased) as hash buckets."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return F.array_distinct(F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int")))


def fit_stars(docs: DataFrame, ratings: DataFrame, stars: int = 5, folds: int = 5) -> tuple[DataFrame, list]:
    """Multinomial naive Bayes from words to stars, once without each fold.

    ``docs`` (doc_id, fold, buckets), ``ratings`` (doc_id, review_score): a
    document counts once per rating. Weights are log shares in whole millionths,
    so that scores are sums of integers and do not depend on their order. Returns
    the weights by (fold, bucket), relative to those of an unseen word, at most
    folds * STAR_BUCKETS rows, and per fold the prior and the unseen word's weight.
    """
    k = range(1, stars + 1)
    rated = ratings.groupBy("doc_id").agg(*[F.count_if(F.col("review_score") == s).alias(f"n{s}") for s in k])
    rows = docs.join(rated, "doc_id")
    sums = rows.groupBy("fold").agg(
        *[F.sum(f"n{s}").alias(f"p{s}") for s in k],
        *[F.sum(F.col(f"n{s}") * F.size("buckets")).alias(f"t{s}") for s in k]).collect()  # a row per fold
    out_of = [[sum(r[f"{c}{s}"] for r in sums if r["fold"] != f) for c in "pt" for s in k] for f in range(folds)]
    million = lambda x: math.floor(1e6 * math.log(x))
    base = [([million((p + 1) / (sum(v[:stars]) + stars)) for p in v[:stars]],
             [million(1 / (t + STAR_BUCKETS)) for t in v[stars:]]) for v in out_of]
    counts = rows.select("fold", F.explode("buckets").alias("bucket"), *[f"n{s}" for s in k]).groupBy(
        "bucket", "fold").agg(*[F.sum(f"n{s}").alias(f"n{s}") for s in k])
    whole = counts.groupBy("bucket").agg(
        F.map_from_entries(F.collect_list(F.struct("fold", F.array(*[f"n{s}" for s in k])))).alias("own"),
        F.array(*[F.sum(f"n{s}") for s in k]).alias("all"))  # folds entries each
    each = whole.select("bucket", "own", "all", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    table = lambda values: F.element_at(F.array(*[F.array(*[F.lit(x).cast("bigint") for x in v])
                                                  for v in values]), F.col("fold") + 1)
    total, unseen = table([v[stars:] for v in out_of]), table([b[1] for b in base])
    left = F.transform("all", lambda n, i: n - F.coalesce(F.try_element_at("own", F.col("fold"))[i], F.lit(0)))
    weight = F.transform(left, lambda n, i: F.floor(
        F.lit(1e6) * F.ln((n + 1) / (total[i] + STAR_BUCKETS))).cast("bigint") - unseen[i])
    return each.select("fold", "bucket", weight.alias("weight")), base


def fold_buckets(docs: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, fold (a hash of the id) and word buckets of every document. Cutting the
    texts is most of the work of :func:`out_of_fold_stars`, which reads them three
    times: write this table once and pass it in place of the documents."""
    part = F.floor(hash_uniform(seed, "doc_id") * folds).cast("int")
    return docs.select("doc_id", part.alias("fold"), word_buckets(F.col("text")).alias("buckets"))


def out_of_fold_stars(docs: DataFrame, ratings: DataFrame, stars: int = 5, folds: int = 5,
                      seed: int = 42) -> DataFrame:
    """doc_id, pred_stars and text_score of every document (doc_id, text; or the
    table of :func:`fold_buckets`, of as many folds), by a
    model that has not seen the document's own ratings.

    Documents fall into ``folds`` parts by a hash of their id; the weights without
    a part score that part. The prediction is the most likely number of stars (of
    equal ones the smaller), the score its probability. Texts are read whole; a
    null text has no word. The weight table has a fixed bound and is broadcast.
    """
    k = range(1, stars + 1)
    rows = docs if "buckets" in docs.columns else fold_buckets(docs, folds, seed)
    weights, base = fit_stars(rows, ratings, stars, folds)
    each = rows.select("doc_id", "fold", F.size("buckets").alias("n_words"), F.explode_outer("buckets").alias("bucket"))
    summed = each.join(F.broadcast(weights), ["fold", "bucket"], "left").groupBy("doc_id", "fold", "n_words").agg(
        *[F.coalesce(F.sum(F.col("weight")[s - 1]), F.lit(0)).alias(f"w{s}") for s in k])
    table = lambda at: F.element_at(F.array(*[F.array(*[F.lit(x).cast("bigint") for x in b[at]])
                                              for b in base]), F.col("fold") + 1)
    prior, unseen = table(0), table(1)
    logit = F.array(*[prior[s - 1] + F.col("n_words") * unseen[s - 1] + F.col(f"w{s}") for s in k])
    scored = summed.select("doc_id", logit.alias("logit")).withColumn("top", F.array_max("logit"))
    parts = F.transform("logit", lambda x: F.exp((x - F.col("top")) / F.lit(1e6)))
    return scored.select("doc_id", F.array_position("logit", F.col("top")).cast("int").alias("pred_stars"),
                         (F.lit(1.0) / F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).alias("text_score"))


Scorer = Callable[[list[str]], list[tuple[str, float]]]


def score_text_batches(df: DataFrame, text: str, scorer_factory: Callable[[], Scorer],
                       batch: int = 32) -> DataFrame:
    """Apply an external scorer in batches of ``batch`` texts per call.

    ``scorer_factory`` builds the model once per task; the scorer maps a list of
    texts to ``(label, score)`` pairs (a NULL text counts as empty). Output adds
    ``text_label`` and ``text_score``.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("text_label", T.StringType()),
                                              T.StructField("text_score", T.DoubleType())])
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for pdf in frames:
            texts = pdf[text].fillna("").astype(str).tolist()
            labels, scores = [], []
            for i in range(0, len(texts), batch):
                for lab, sc in scorer(texts[i:i + batch]):
                    labels.append(lab)
                    scores.append(float(sc))
            yield pdf.assign(text_label=labels, text_score=scores)

    return df.mapInPandas(run, schema)


def route(features_scored: DataFrame, text_scored: DataFrame, key: str = "order_id",
          risk_threshold: float = 0.5) -> DataFrame:
    """Work queue: at-risk orders before a review -> 'outreach'; negative
    review text after it -> 'human_review', unless already queued.

    ``features_scored`` has ``key`` and ``y_proba`` = P(positive);
    ``text_scored`` has ``key``, ``pred_binary`` and ``text_score``.
    """
    outreach = (features_scored.where(F.col("y_proba") < risk_threshold)
                .select(key, F.lit("outreach").alias("reason"),
                        (F.lit(1.0) - F.col("y_proba")).alias("score")))
    human = (text_scored.where(F.col("pred_binary") == 0)
             .groupBy(key).agg(F.max("text_score").alias("score"))
             .join(outreach.select(key), key, "left_anti")
             .select(key, F.lit("human_review").alias("reason"), "score"))
    return outreach.unionByName(human)
