"""Distribution drift: PSI on reference edges and the two-sample KS test.

Input is long form: ``ref`` = (feature, value) and ``cur`` = (feature,
<by>, value); :func:`to_long` unpivots wide frames. All features and groups
are computed in one job each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.columns import bin_index, ks_exact_pvalue, ks_pvalue, linspace_inner, nan_to_null, severity
from orderpulse.operators.metrics import exact_quantile, running_below

# PSI defaults (10 equal-width bins over [min, p99] of the
# reference, 1e-4 added to every share) and the KS significance level.
N_BINS = 10
EPSILON = 1e-4
CLIP_QUANTILE = 0.99
ALPHA = 0.05


def to_long(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, value), values as double, NaN as NULL. NULL values stay,
    so that a group without any value of a feature is still a group."""
    keep = keep or []
    cast = df.select(*keep, *[nan_to_null(F.col(f).cast("double")).alias(f) for f in features])
    return cast.unpivot(keep, features, "feature", "value")


SKETCH_K = 4096  # a rank is off by about 0.07 % of the values; about 100 KB a sketch
SKETCH_RANK_ERROR = 0.02  # what the reports that use sketches allow


def feature_sketches(long: DataFrame, by: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """(feature, by..., sketch, n, least): a mergeable quantile sketch (KLL) of each
    group's values, of bounded size however large the group. Store them once;
    :func:`merged_sketches` answers for any union of groups without the rows."""
    return (long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("feature", *(by or []))
            .agg(F.kll_sketch_agg_double("value", k).alias("sketch"), F.count(F.lit(1)).alias("n"),
                 F.min("value").alias("least")))


def merged_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of whole groups of stored sketches."""
    return sketches.groupBy("feature", *(by or [])).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.min("least").alias("least"))


def reference_edges(ref: DataFrame, n_bins: int = N_BINS, clip: float = CLIP_QUANTILE,
                    approx: bool = False) -> DataFrame:
    """(feature, edges): the inner edges of ``linspace(min, p_clip, n_bins+1)``.

    The clip quantile is exact and equal to numpy's (distributed: see
    :func:`~orderpulse.operators.metrics.exact_quantile`); ``approx`` takes it from
    a quantile sketch instead (one pass, bounded memory; stored ones can be merged).
    """
    if approx:
        sk = merged_sketches(feature_sketches(ref))
        at = F.kll_sketch_get_quantile_double("sketch", F.lit(clip)).alias("ref_clip")
        return sk.select("feature", F.col("least").alias("ref_min"), at).withColumn(
            "edges", linspace_inner("ref_min", "ref_clip", n_bins))
    ref = ref.where(F.col("value").isNotNull())
    mins = ref.groupBy("feature").agg(F.min("value").alias("ref_min"))
    clip_q = exact_quantile(ref, "value", clip, "feature", "ref_clip")
    stats = mins.join(clip_q, "feature", "inner")
    return stats.select("feature", "ref_min", "ref_clip",
                        linspace_inner("ref_min", "ref_clip", n_bins).alias("edges"))


def _bin_counts(df: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    # edges: one row per feature; unless it is broadcast, all values are shuffled to a task per feature
    return (df.where(F.col("value").isNotNull()).join(F.broadcast(edges.select("feature", "edges")), "feature", "inner")
            .withColumn("bin", bin_index("value", "edges"))
            .groupBy("feature", *by, "bin").agg(F.count(F.lit(1)).alias("n")))


def reference_bins(ref: DataFrame, edges: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """(feature, edges, shares): the share of each of the reference's bins, one row per feature."""
    n = _bin_counts(ref, edges, []).groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"), F.sum("n").alias("total"))
    share = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)),
                        lambda b: F.coalesce(F.try_element_at("by_bin", b), F.lit(0)) / F.col("total"))
    return edges.join(n, "feature").select("feature", "edges", share.alias("shares"))


def psi(ref: DataFrame, cur: DataFrame, by: list[str] | str = "month", n_bins: int = N_BINS,
        clip: float = CLIP_QUANTILE, eps: float = EPSILON, approx: bool = False) -> DataFrame:
    """PSI per (feature, by...): sum((c - r) * ln(c / r)) over bins.

    Shares are count / total + eps (not renormalised); bins are [e_i, e_i+1)
    with infinite outer bins; empty bins count as share eps. A group without
    any value of a feature has a NULL PSI (severity RED).
    """
    by = [by] if isinstance(by, str) else list(by)
    edges = reference_edges(ref, n_bins, clip, approx)
    rc = _bin_counts(ref, edges, [])
    cc = _bin_counts(cur, edges, by)
    r_tot = Window.partitionBy("feature")
    c_tot = Window.partitionBy("feature", *by)
    r_share = rc.select("feature", "bin",
                        (F.col("n") / F.sum("n").over(r_tot)).alias("r_share"))
    # scaffold: every (feature, group) gets all n_bins bins, so empty bins exist
    groups = cur.select("feature", *by).distinct()
    scaffold = groups.select("feature", *by,
                             F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    c_share = (scaffold.join(cc, ["feature", *by, "bin"], "left")
               .withColumn("n", F.coalesce("n", F.lit(0)))
               .withColumn("c_share", F.try_divide(F.col("n"), F.sum("n").over(c_tot))))
    j = c_share.join(r_share, ["feature", "bin"], "left") \
        .withColumn("r", F.coalesce("r_share", F.lit(0.0)) + F.lit(eps)) \
        .withColumn("c", F.col("c_share") + F.lit(eps))
    return (j.groupBy("feature", *by)
            .agg(F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))).alias("psi")))


def psi_with_severity(psi_df: DataFrame) -> DataFrame:
    return psi_df.withColumn("severity", severity("psi"))


def ks_neighbours(long: DataFrame, by: str = "month", alpha: float = ALPHA,
                  exact_up_to: int = 10_000) -> DataFrame:
    """KS of every group against the one before it (``by`` one less), per feature.

    The values of a pair of groups are put in order once; both CDFs are running
    sums over it. The p-value is exact while both samples have up to
    ``exact_up_to`` values, and asymptotic beyond. Groups without a value of a
    feature, or without a neighbour, give no row.
    """
    g = long.where(F.col("value").isNotNull()).groupBy("feature", by, "value").agg(F.count(F.lit(1)).alias("n"))
    pair = F.explode(F.array(F.struct(F.col(by).alias("m"), F.lit(1).alias("own")),
                             F.struct((F.col(by) + 1).alias("m"), F.lit(0).alias("own"))))
    g = g.select("feature", "value", "n", pair.alias("p")).groupBy("feature", F.col("p.m").alias(by), "value").agg(
        F.sum(F.when(F.col("p.own") == 0, F.col("n")).otherwise(0)).alias("_r"),
        F.sum(F.when(F.col("p.own") == 1, F.col("n")).otherwise(0)).alias("_c"))
    tot = g.groupBy("feature", by).agg(F.sum("_r").alias("n_ref"), F.sum("_c").alias("n_cur")).where(
        "n_ref > 0 and n_cur > 0")
    run = running_below(g.join(tot, ["feature", by]), ["feature", by], "value", ["_r", "_c"], ["_rb", "_cb"])
    # whole numbers up to the end: n_ref * n_cur times the statistic
    gap = F.abs((F.col("_rb") + F.col("_r")) * F.col("n_cur") - (F.col("_cb") + F.col("_c")) * F.col("n_ref"))
    stat = run.groupBy("feature", by, "n_ref", "n_cur").agg(F.max(gap).alias("_gap")).withColumn(
        "ks_stat", F.col("_gap") / (F.col("n_ref") * F.col("n_cur")))
    small = F.greatest("n_ref", "n_cur") <= exact_up_to
    exact = ks_exact_pvalue(F.when(small, F.col("ks_stat")), "n_ref", "n_cur")
    rows = stat.withColumn("_exact", exact).withColumn(
        "p_value", F.when(small, F.col("_exact")).otherwise(ks_pvalue("ks_stat", "n_ref", "n_cur")))
    return rows.select("feature", by, "ks_stat", "p_value", (F.col("p_value") < alpha).cast("int").alias("significant"),
                       F.col("n_ref").cast("bigint"), F.col("n_cur").cast("bigint"))


def ks(ref: DataFrame, cur: DataFrame, groups: list, by: str = "month",
       alpha: float = ALPHA, buckets="auto") -> DataFrame:
    """Two-sample KS statistic and asymptotic p-value per (feature, group).

    Values are grouped first (ties collapse), with a count per group as
    columns (reference + one per ``groups`` value), and ONE ordered running
    sum per feature gives every CDF; the statistic is max |F_ref - F_g|. A
    group without any value of a feature has NULL statistic and p-value and
    counts as significant.
    """
    ref, cur = (x.where(F.col("value").isNotNull()) for x in (ref, cur))
    names = [f"_c{i}" for i in range(len(groups))]
    rows = ref.select("feature", "value", F.lit(True).alias("_ref"),
                      F.lit(None).cast(cur.schema[by].dataType).alias(by)).unionByName(
        cur.where(F.col(by).isin(groups)).select("feature", "value", F.lit(False).alias("_ref"), by))
    cols = ["_r", *names]
    counts = {"_r": F.count_if("_ref"), **{n: F.count_if(~F.col("_ref") & (F.col(by) == F.lit(g)))
                                           for g, n in zip(groups, names)}}
    allv = rows.groupBy("feature", "value").agg(*[x.alias(c) for c, x in counts.items()])
    run = running_below(allv, ["feature"], "value", cols, [f"{c}_below" for c in cols], buckets,
                        rows.select("feature", "value"))
    # per-feature totals: a row per feature, counted before any shuffle
    tot = F.broadcast(rows.groupBy("feature").agg(*[x.alias(f"_t{c}") for c, x in counts.items()]))
    run = run.join(tot, "feature", "inner")
    stats = []
    for c in names:
        cdf_r = (F.col("_r_below") + F.col("_r")) / F.col("_t_r")
        cdf_c = F.try_divide(F.col(f"{c}_below") + F.col(c), F.col(f"_t{c}"))
        stats.append(F.abs(cdf_r - cdf_c).alias(f"_d{c}"))
    agg = run.select("feature", *stats).groupBy("feature").agg(
        *[F.max(f"_d{c}").alias(f"_D{c}") for c in names])
    agg = agg.join(tot, "feature", "inner")
    rows = agg.select("feature", F.col("_t_r").alias("n_ref"), F.explode(F.array(*[
        F.struct(F.lit(g).alias(by), F.col(f"_t{c}").alias("n_cur"), F.col(f"_D{c}").alias("ks_stat"))
        for g, c in zip(groups, names)])).alias("s")).select("feature", "n_ref", "s.*")
    p = ks_pvalue("ks_stat", "n_ref", "n_cur")
    return rows.select("feature", by, "ks_stat", p.alias("p_value"),
                       F.coalesce(p < F.lit(alpha), F.lit(True)).cast("int").alias("significant"),
                       F.col("n_ref").cast("bigint"), F.col("n_cur").cast("bigint"))
