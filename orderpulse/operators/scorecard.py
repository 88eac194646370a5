"""Scorecard: a fitted feature model that is a plain column expression.

Every feature is cut into classes (ten equal widths of the training rows up to
their 99th percentile, or its category; 'missing' for NULL). A class weighs the log
ratio of its shares among positive and negative training rows, in whole
millionths, so a score is a sum of integers and the same on every engine. Fitting
is one grouped count over all training rows; scoring needs no join and no model
file, which suits streams and validation batches.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse import CATEGORICAL_FEATURES, LABEL, NUMERIC_FEATURES
from orderpulse.functions.columns import bin_index
from orderpulse.operators.drift import reference_edges, to_long

SMOOTH = 10  # added to the totals, one of it to every class


class Scorecard(NamedTuple):
    edges: dict[str, list[float]]  # inner edges of the numeric features
    weights: dict[str, dict[str, int]]
    unseen: int
    prior: int

    def classes(self) -> dict[str, Column]:
        return _classes(self.edges, list(self.weights))

    def logit(self) -> Column:
        """Millionths of the log odds of a positive label."""
        total = F.lit(self.prior).cast("bigint")
        for f, c in self.classes().items():
            table = F.create_map(*[F.lit(x) for k, w in self.weights[f].items() for x in (k, w)]).cast("map<string,bigint>")
            total = total + F.coalesce(F.try_element_at(table, c), F.lit(self.unseen))
        return total

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``y_proba`` = P(positive) and ``y_pred`` (1 from even odds on)."""
        out = df.withColumn("_logit", self.logit())
        return out.withColumn("y_proba", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_logit") / F.lit(1e6)))).withColumn(
            "y_pred", (F.col("_logit") >= 0).cast("int")).drop("_logit")


def _classes(edges: dict[str, list[float]], features: list[str]) -> dict[str, Column]:
    out = {}
    for f in features:
        v = F.col(f)
        if f in edges:
            cut = bin_index(v.cast("double"), F.array(*[F.lit(float(x)) for x in edges[f]]))
            out[f] = F.when(v.isNull() | F.isnan(v.cast("double")), F.lit("missing")).otherwise(cut.cast("string"))
        else:
            out[f] = F.coalesce(v, F.lit("missing"))
    return out


def fit(train: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None,
        label: str = LABEL) -> Scorecard:
    """Count the classes of all training rows. What reaches the driver is a row per
    feature and class: eleven at most for a number, the distinct values of a category."""
    numeric, categorical = numeric or NUMERIC_FEATURES, categorical or CATEGORICAL_FEATURES
    edges = {r["feature"]: list(r["edges"]) for r in reference_edges(to_long(train, numeric)).collect()}
    edges = {f: edges.get(f, []) for f in numeric}
    features = [*numeric, *categorical]
    rows = train.where(F.col(label).isNotNull()).select(
        F.col(label).alias("_y"), *[c.alias(f) for f, c in _classes(edges, features).items()])
    counted = rows.unpivot(["_y"], features, "feature", "class").groupBy("feature", "class").agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")).collect()
    pos, neg = (sum(r[c] for r in counted if r["feature"] == features[0]) for c in ("pos", "neg"))

    def weight(p: int, n: int) -> int:
        return math.floor(1e6 * math.log(((p + 1) / (pos + SMOOTH)) / ((n + 1) / (neg + SMOOTH))))

    weights = {f: {r["class"]: weight(r["pos"], r["neg"]) for r in counted if r["feature"] == f} for f in features}
    return Scorecard(edges, weights, weight(0, 0), math.floor(1e6 * math.log((pos + 1) / (neg + 1))))
