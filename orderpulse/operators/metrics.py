"""Classification metrics, ROC AUC, threshold sweep, crosstab, distributions.

Everything is one grouped aggregate over the scored rows; nothing is
collected. AUC uses exact integer rank sums (ties count one half) and a
two-level prefix sum, so no window ever sees all scores in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.columns import col_, safe_div

METRIC_NAMES = ["accuracy", "precision_pos", "recall_pos", "f1_pos", "recall_neg", "f1_macro"]


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


# the ordered plans aim at this many distinct ordering values per bucket
ROWS_PER_BUCKET = 1_000_000


def _resolve_buckets(g: DataFrame, keys: list[str], buckets):
    """``buckets='auto'``: one small job reads the largest group's row count (of ``g``,
    which may hold a value more than once: rows are counted before any shuffle).
    Groups of up to ROWS_PER_BUCKET rows are ordered in one window each (None);
    beyond that there is a bucket per so many rows, so a hot group is spread
    over tasks in proportion to its size."""
    if buckets != "auto":
        return buckets
    biggest = _largest(g, keys)
    return -(-biggest // ROWS_PER_BUCKET) if biggest > ROWS_PER_BUCKET else None


def _largest(g: DataFrame, keys: list[str]) -> int:
    return g.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def distribution(df: DataFrame, col: str, normalize: bool = True) -> DataFrame:
    """value_counts sorted by value; with ``share`` = n / total when normalize."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    if normalize:
        # total as a scalar subquery: no single-partition window
        g = g.withColumn("share", F.col("n") / g.agg(F.sum("n")).scalar())
    return g.orderBy(col)


def confusion_counts(df: DataFrame, y: str, pred: str, by=None) -> DataFrame:
    yy, pp = col_(y), col_(pred)
    return df.groupBy(*_by(by)).agg(
        F.count_if((yy == 1) & (pp == 1)).cast("bigint").alias("tp"),
        F.count_if((yy == 0) & (pp == 1)).cast("bigint").alias("fp"),
        F.count_if((yy == 0) & (pp == 0)).cast("bigint").alias("tn"),
        F.count_if((yy == 1) & (pp == 0)).cast("bigint").alias("fn"),
    )


def metrics_from_counts(c: DataFrame) -> DataFrame:
    """Accuracy, precision / recall / F1 for both classes and macro F1.

    A zero denominator gives 0, as the usual metric libraries report.
    """
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    prec_p, rec_p = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    prec_n, rec_n = safe_div(tn, tn + fn), safe_div(tn, tn + fp)
    f1_p = safe_div(2 * tp, 2 * tp + fp + fn)
    f1_n = safe_div(2 * tn, 2 * tn + fn + fp)
    return c.select(
        "*",
        safe_div(tp + tn, n).alias("accuracy"),
        prec_p.alias("precision_pos"), rec_p.alias("recall_pos"), f1_p.alias("f1_pos"),
        prec_n.alias("precision_neg"), rec_n.alias("recall_neg"), f1_n.alias("f1_neg"),
        ((f1_p + f1_n) / 2).alias("f1_macro"),
    )


def confusion_metrics(df: DataFrame, y: str, pred: str, by=None) -> DataFrame:
    return metrics_from_counts(confusion_counts(df, y, pred, by))


def _score_counts(df: DataFrame, y: str, score: str, by) -> DataFrame:
    keys = _by(by)
    return (df.where(col_(score).isNotNull() & col_(y).isNotNull())
            .groupBy(*keys, F.col(score).alias("_s"))
            .agg(F.count_if(col_(y) == 1).cast("bigint").alias("_pos"),
                 F.count_if(col_(y) == 0).cast("bigint").alias("_neg")))


def running_below(g: DataFrame, by, order_col: str, value_cols, outs,
                  buckets="auto", rows: DataFrame | None = None) -> DataFrame:
    """For each value column, the sum over rows with a smaller ``order_col``
    in the same ``by`` group (strictly below; ``order_col`` unique per group).

    Two levels: bucket the order values by approximate quantiles, prefix-sum
    the per-bucket totals (tiny table), then window inside each bucket only.
    The result is exact whatever the quantiles are. Every row is ordered
    here, so buckets also spread a group over tasks. ``'auto'`` (default)
    picks by the largest group's size (:func:`_resolve_buckets`); ``None``
    uses one window per group; an int fixes the bucket count. ``rows`` (the
    rows that ``g`` groups: ``by`` and ``order_col``) are then counted and
    sketched in place of ``g``, before any shuffle. Bounds and totals have a
    row per group or bucket and are broadcast: joined on a few groups' keys,
    all of ``g`` would end in as few tasks.
    """
    keys = _by(by)
    rows = g if rows is None else rows
    buckets = _resolve_buckets(rows, keys, buckets)
    vals = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    outs = [outs] if isinstance(outs, str) else list(outs)
    prev = Window.partitionBy(*keys, *(["_b"] if buckets else [])).orderBy(order_col) \
        .rowsBetween(Window.unboundedPreceding, -1)
    if not buckets:
        for v, o in zip(vals, outs):
            g = g.withColumn(o, F.coalesce(F.sum(v).over(prev), F.lit(0)))
        return g
    fracs = [i / buckets for i in range(1, buckets)]
    bounds = rows.groupBy(*keys).agg(
        F.percentile_approx(order_col, fracs, 10000).alias("_bounds"))
    if keys:
        gb = g.join(F.broadcast(bounds), keys, "inner")
    else:
        gb = g.withColumn("_bounds", bounds.select("_bounds").scalar())
    gb = gb.withColumn("_b", F.size(F.filter("_bounds", lambda b: b <= F.col(order_col)))) \
        .drop("_bounds")
    tot = gb.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_bt{i}") for i, v in enumerate(vals)])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_b", *[F.coalesce(F.sum(f"_bt{i}").over(before), F.lit(0))
                                    .alias(f"_off{i}") for i in range(len(vals))])
    gb = gb.join(F.broadcast(tot), [*keys, "_b"], "inner")
    for i, (v, o) in enumerate(zip(vals, outs)):
        gb = gb.withColumn(o, F.col(f"_off{i}") + F.coalesce(F.sum(v).over(prev), F.lit(0)))
    return gb.drop("_b", *[f"_off{i}" for i in range(len(vals))])


def roc_auc(df: DataFrame, y: str, score: str, by=None, buckets="auto") -> DataFrame:
    """Exact ROC AUC per group: P(s+ > s-) + P(s+ = s-) / 2.

    Integer numerator ``sum(2 * pos * neg_below + pos * neg)`` over distinct
    scores, divided once by ``2 * P * N``. One class only -> NULL.
    """
    keys = _by(by)
    g = _score_counts(df, y, score, keys)
    g = running_below(g, keys, "_s", "_neg", "_neg_below", buckets)
    wide = lambda c: F.col(c).cast("decimal(18,0)")  # noqa: E731  products beyond 64 bits
    agg = g.groupBy(*keys).agg(
        F.sum((wide("_pos") * (wide("_neg_below") * 2 + wide("_neg"))).cast("decimal(38,0)"))
        .alias("_num"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    den = wide("n_pos") * wide("n_neg") * 2
    return agg.select(*keys, F.try_divide(F.col("_num").cast("double"), den.cast("double"))
                      .alias("auc"), F.col("n_pos").cast("bigint"), F.col("n_neg").cast("bigint"))


def default_grid(step_count: int = 20) -> list[float]:
    """0.05, 0.10, ..., 0.95 as j / 20 (exact nearest doubles)."""
    return [j / step_count for j in range(1, step_count)]


def threshold_sweep(df: DataFrame, y: str, score: str, grid: list[float] | None = None,
                    by=None) -> DataFrame:
    """Confusion counts and rates for each threshold ``t`` (pred = score >= t).

    Scores are first reduced to a histogram over the grid cells; each cell
    then contributes to the thresholds at or below it (at most len(grid)
    rows per cell).
    """
    keys = _by(by)
    grid = grid or default_grid()
    g_arr = F.array(*[F.lit(float(t)) for t in grid])
    hist = (df.where(col_(score).isNotNull() & col_(y).isNotNull())
            .withColumn("_k", F.size(F.filter(g_arr, lambda t: t <= col_(score))))
            .groupBy(*keys, "_k")
            .agg(F.count_if(col_(y) == 1).cast("bigint").alias("_pos"),
                 F.count_if(col_(y) == 0).cast("bigint").alias("_neg")))
    totals = hist.groupBy(*keys).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    # a cell k (k grid points <= score) is predicted positive for thresholds 0..k-1
    pos_side = (hist.where(F.col("_k") > 0)
                .select(*keys, F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_j"),
                        "_pos", "_neg")
                .groupBy(*keys, "_j").agg(F.sum("_pos").alias("tp"), F.sum("_neg").alias("fp")))
    thr = (totals.select(*keys, "_P", "_N",
                         F.posexplode(g_arr).alias("_j", "threshold")))
    out = thr.join(pos_side, [*keys, "_j"], "left").select(
        *keys, "threshold",
        F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"),
        F.coalesce("fp", F.lit(0)).cast("bigint").alias("fp"),
        (F.col("_N") - F.coalesce("fp", F.lit(0))).cast("bigint").alias("tn"),
        (F.col("_P") - F.coalesce("tp", F.lit(0))).cast("bigint").alias("fn"))
    return metrics_from_counts(out)


def compare_models(a: DataFrame, b: DataFrame, name_a: str = "model_a",
                   name_b: str = "model_b", metrics: list[str] | None = None) -> DataFrame:
    """Two one-row metric tables -> (metric, a, b, winner) with 'Tie'."""
    metrics = metrics or METRIC_NAMES

    def long(df, name):
        return df.select(*metrics).unpivot([], metrics, "metric", name)

    j = long(a, name_a).join(long(b, name_b), "metric")
    fa, fb = F.col(name_a), F.col(name_b)
    return j.withColumn("winner", F.when(fa > fb, F.lit(name_a)).when(fb > fa, F.lit(name_b))
                        .otherwise(F.lit("Tie")))


def cost_curve(df: DataFrame, y: str, score: str, cost_missed: float = 5.0, cost_false: float = 1.0,
               steps: int = 1000, by=None) -> DataFrame:
    """Cost of every threshold ``k / steps`` on P(negative) = 1 - ``score``.

    A row is called negative when its step ``floor((1 - score) * steps)`` is ``k``
    or more. A negative that is not called costs ``cost_missed``, a positive that
    is called ``cost_false``. One histogram of at most steps + 1 rows per group is
    counted; prefix sums over it give all thresholds. ``is_best`` marks the least
    cost, the highest such threshold. Rows without a score or label do not count.
    """
    keys = _by(by)
    step = F.least(F.floor((F.lit(1.0) - col_(score)) * steps), F.lit(steps)).cast("int")
    hist = df.where(col_(score).isNotNull() & col_(y).isNotNull()).groupBy(*keys, step.alias("_k")).agg(
        F.count_if(col_(y) == 0).alias("_neg"), F.count_if(col_(y) == 1).alias("_pos"))
    groups = hist.select(*keys).distinct() if keys else hist.agg(F.count(F.lit(1)).alias("_any")).drop("_any")
    grid = groups.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_k"))
    cells = grid.join(hist, [*keys, "_k"], "left").fillna(0, ["_neg", "_pos"])
    order = Window.partitionBy(*keys).orderBy("_k")  # steps + 1 rows
    missed = F.coalesce(F.sum("_neg").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    false = F.sum("_pos").over(order.rowsBetween(0, Window.unboundedFollowing))
    out = cells.select(*keys, (F.col("_k") / F.lit(float(steps))).alias("threshold"), F.col("_k").alias("step"),
                       missed.cast("bigint").alias("n_missed"), false.cast("bigint").alias("n_false"))
    out = out.withColumn("cost", F.col("n_missed") * float(cost_missed) + F.col("n_false") * float(cost_false))
    best = Window.partitionBy(*keys).orderBy("cost", F.desc("step"))
    return out.withColumn("is_best", (F.row_number().over(best) == 1).cast("int"))


def weighted_median(df: DataFrame, value: str, weight: str, by=None, out: str = "q",
                    buckets="auto") -> DataFrame:
    """Median of weighted values per group: the mean of the least value that half
    of the weight does not exceed and the least value that it exceeds. Whole
    weights give the median of the rows repeated so often."""
    keys = _by(by)
    v = col_(value)
    g = (df.where(v.isNotNull() & ~F.isnan(v) & (col_(weight) > 0))
         .groupBy(*keys, v.cast("double").alias("_v")).agg(F.sum(col_(weight).cast("double")).alias("_w")))
    half = g.groupBy(*keys).agg((F.sum("_w") / 2).alias("_half"))
    run = running_below(g, keys, "_v", "_w", "_below", buckets)
    run = run.join(half, keys) if keys else run.withColumn("_half", half.select("_half").scalar())
    upto = F.col("_below") + F.col("_w")
    low, high = (F.min(F.when(c, F.col("_v"))) for c in (upto >= F.col("_half"), upto > F.col("_half")))
    # sums of fractions can miss the last half by a rounding: the largest value stands in
    return run.groupBy(*keys).agg(low.alias("_a"), high.alias("_b"), F.max("_v").alias("_z")).select(
        *keys, ((F.coalesce("_a", "_z") + F.coalesce("_b", "_z")) / 2).alias(out))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts of ``row`` x ``col`` with the given column values; gaps are 0."""
    return (df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1)))
            .na.fill(0).orderBy(row))


def exact_quantile(df: DataFrame, value: str, q: float, by=None, out: str = "q",
                   buckets="auto") -> DataFrame:
    """Exact quantile with linear interpolation (numpy's default) per group.

    Distributed: values are grouped (ties collapse) and cut into buckets at
    approximate quantiles; per-bucket counts (a tiny table) locate the one or
    two buckets holding ranks floor((n-1)q) and the next, and only those
    buckets' rows are ordered. No buffer or window ever holds all values of
    a group (unlike the ``percentile`` aggregate). ``buckets=None`` orders
    whole groups; ``'auto'`` does so while no group has more than
    ROWS_PER_BUCKET rows, and beyond that shuffles only the values next to the
    quantile (:func:`_values_near`).
    """
    keys = _by(by)
    v = col_(value)
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.cast("double").alias("_v"))
    if buckets == "auto":
        if _largest(rows, keys) > ROWS_PER_BUCKET:
            return _quantile_at(_values_near(rows, q, keys), keys, keys, out)
        buckets = None
    g = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    if buckets:
        fracs = [i / buckets for i in range(1, buckets)]
        bounds = g.groupBy(*keys).agg(F.percentile_approx("_v", fracs, 10000).alias("_bounds"))
        gb = (g.join(bounds, keys, "inner") if keys
              else g.withColumn("_bounds", bounds.select("_bounds").scalar()))
        gb = gb.withColumn("_b", F.size(F.filter("_bounds", lambda b: b <= F.col("_v")))) \
            .drop("_bounds")
    else:
        gb = g.withColumn("_b", F.lit(0))
    # per-bucket counts and offsets: at most groups * buckets rows
    tot = gb.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bt"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    tot = (tot.withColumn("_off", F.coalesce(F.sum("_bt").over(before), F.lit(0)))
           .withColumn("_n", F.sum("_bt").over(whole)))
    tot = _ranks(tot, q)
    inb = lambda r: (F.col("_off") <= F.col(r)) & (F.col(r) < F.col("_off") + F.col("_bt"))
    target = tot.where(inb("_lo") | inb("_hi")).select(*keys, "_b", "_off", "_pos", "_lo", "_hi")
    return _quantile_at(gb.join(target, [*keys, "_b"], "inner"), keys, [*keys, "_b"], out)


def _ranks(tot: DataFrame, q: float) -> DataFrame:
    """Adds the quantile's place among ``_n`` values and the two ranks beside it."""
    pos = (F.col("_n") - 1).cast("double") * F.lit(float(q))
    return (tot.withColumn("_pos", pos).withColumn("_lo", F.floor(pos).cast("long"))
            .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1)))


SKETCH_ACCURACY = 10_000  # of approximate percentiles: ranks off by one in so many
NEAR = 10 / SKETCH_ACCURACY  # share of the values kept on either side of a quantile


def _values_near(rows: DataFrame, q: float, keys: list[str]) -> DataFrame:
    """The distinct values next to the quantile with their counts (``_c``), how many
    values lie below all of them (``_off``) and the ranks asked for.

    A sketch of each group gives two values around the quantile, a second pass counts
    exactly what lies below and up to them: both are partial aggregates, whatever the
    number of rows. Where the ranks are not between the two, that side stays open, so
    the result is exact whatever the sketch says."""
    each = lambda df, few: df.join(F.broadcast(few), keys) if keys else df.crossJoin(F.broadcast(few))
    around = rows.groupBy(*keys).agg(F.percentile_approx(
        "_v", [max(0.0, q - NEAR), min(1.0, q + NEAR)], SKETCH_ACCURACY).alias("_p")) \
        .select(*keys, F.col("_p")[0].alias("_a"), F.col("_p")[1].alias("_z"))
    counts = each(rows, around).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_v") < F.col("_a")).alias("_under"),
        F.count_if(F.col("_v") <= F.col("_z")).alias("_upto"), F.first("_a").alias("_a"), F.first("_z").alias("_z"))
    low = F.col("_under") <= F.col("_lo")
    target = _ranks(counts, q).select(
        *keys, "_pos", "_lo", "_hi", F.when(low, F.col("_under")).otherwise(F.lit(0)).alias("_off"),
        F.when(low, F.col("_a")).alias("_from"), F.when(F.col("_hi") < F.col("_upto"), F.col("_z")).alias("_to"))
    inside = (F.col("_from").isNull() | (F.col("_v") >= F.col("_from"))) & (
        F.col("_to").isNull() | (F.col("_v") <= F.col("_to")))
    return each(rows, target).where(inside).groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(c) for c in ("_off", "_pos", "_lo", "_hi")])


def _quantile_at(rows: DataFrame, keys: list[str], parts: list[str], out: str) -> DataFrame:
    prev = Window.partitionBy(*parts).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_below", F.col("_off") + F.coalesce(F.sum("_c").over(prev), F.lit(0)))
    hit = lambda r: (F.col("_below") <= F.col(r)) & (F.col(r) < F.col("_below") + F.col("_c"))
    picked = rows.where(hit("_lo") | hit("_hi")).groupBy(*keys).agg(
        F.max(F.when(hit("_lo"), F.col("_v"))).alias("_a"),
        F.max(F.when(hit("_hi"), F.col("_v"))).alias("_bv"),
        F.first("_pos").alias("_pos"), F.first("_lo").alias("_lo"))
    t = F.col("_pos") - F.col("_lo").cast("double")
    d = F.col("_bv") - F.col("_a")
    # numpy's linear interpolation, bit for bit: a + d*t below t = 0.5,
    # b - d*(1-t) from there on
    val = F.when(t >= 0.5, F.col("_bv") - d * (F.lit(1.0) - t)).otherwise(F.col("_a") + d * t)
    return picked.select(*keys, val.alias(out))
