"""Seeded sampling that gives the same rows whatever the partitioning.

Every choice is a function of ``md5(seed:key)``, never of ``rand()`` or
row positions, so retries, re-partitioning and another engine all select
the same rows.

Dense row numbers (needed for an exact-n bootstrap and exact stratified
quotas) come from two levels: rows are bucketed by the first hex digits of
their hash (uniform by construction, so buckets are even), bucket sizes are
prefix-summed on the tiny bucket table, and ``row_number`` runs only inside
a bucket. No window ever holds a whole table or a whole class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderpulse.functions.columns import hash_hex, hash_uniform


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


# hex digits of the hash bucket: 65,536 buckets per group at any size of table
BUCKET_DIGITS = 4


def dense_row_number(df: DataFrame, order_hash: str, tie: str, by=None,
                     out: str = "row_no", hex_digits: int = BUCKET_DIGITS) -> DataFrame:
    """0-based position of each row in ``(order_hash, tie)`` order per group.

    ``order_hash`` is a hex string column (e.g. :func:`hash_hex`). Buckets =
    first ``hex_digits`` hex characters (16**hex_digits buckets), so a hot
    group is spread over many windows.
    """
    keys = _by(by)
    b = df.withColumn("_bk", F.substring(order_hash, 1, hex_digits))
    sizes = b.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "_bk").orderBy(order_hash, tie)
    # offs has groups * 16**hex_digits rows: no hint, AQE broadcasts it when
    # its measured size is small; otherwise the join's (keys, _bk) shuffle is
    # the one the bucket window needs anyway
    return (b.join(offs, [*keys, "_bk"], "inner")
            .withColumn(out, (F.col("_off") + F.row_number().over(inner) - 1).cast("bigint"))
            .drop("_bk", "_off"))


def sample_n(df: DataFrame, n: int, key: str, seed=42, by=None) -> DataFrame:
    """Exactly ``min(n, size)`` rows without replacement (per group if ``by``).

    Without groups this is a top-n on the hash (TakeOrderedAndProject: each
    task keeps n rows, the driver merges n per task).
    """
    keys = _by(by)
    h = hash_hex(seed, key)
    if not keys:
        return (df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h"))
    ranked = dense_row_number(df.withColumn("_h", h), "_h", key, keys, "_r")
    return ranked.where(F.col("_r") < n).drop("_h", "_r")


def stratified_split(df: DataFrame, label: str, key: str, frac: float = 0.2, seed=42,
                     exact: bool = False, out: str = "split") -> DataFrame:
    """Adds ``split`` = 'test' / 'train'.

    Default: test iff ``u(seed:key) < frac`` - about ``frac`` of every class,
    no shuffle, same rows on any layout. ``exact=True``: per class the first
    ``ceil(frac * n_class)`` rows in hash order (dense two-level ranks).
    """
    if not exact:
        return df.withColumn(out, F.when(hash_uniform(seed, key) < F.lit(frac), F.lit("test"))
                             .otherwise(F.lit("train")))
    ranked = dense_row_number(df.withColumn("_h", hash_hex(seed, key)), "_h", key, label, "_r")
    quota = ranked.groupBy(label).agg(F.ceil(F.count(F.lit(1)) * F.lit(frac)).alias("_q"))
    return (ranked.join(quota, label, "inner")
            .withColumn(out, F.when(F.col("_r") < F.col("_q"), F.lit("test"))
                        .otherwise(F.lit("train")))
            .drop("_h", "_r", "_q"))


def bootstrap(spark: SparkSession, df: DataFrame, n, key: str, seed=42,
              groups: list | None = None, group_col: str = "month") -> DataFrame:
    """Exact-n draws with replacement from ``df``, optionally per group.

    Population rows get dense ids 0..N-1 (hash order); ``n`` draws per group
    come from ``spark.range`` (distributed), each mapped to
    ``floor(u(seed:group:draw) * N)`` and joined to the population by id.
    ``n=None`` draws N rows (a classic bootstrap, grows with the data).
    Output: population columns + ``group_col`` + ``draw``.
    """
    pop = dense_row_number(df.withColumn("_h", hash_hex(seed, key)), "_h", key, None, "_id") \
        .drop("_h")
    n_pop = df.select(F.count(F.lit(1))).scalar()
    groups = groups or [1]
    g_arr = F.array(*[F.lit(g) for g in groups])
    if n is None:
        # N draws per group: the population's own ids serve as draw numbers,
        # so the draw table is as distributed as the population itself.
        draws = pop.select(F.col("_id").alias("draw")) \
            .select(F.explode(g_arr).alias(group_col), "draw")
    else:
        draws = spark.range(len(groups) * int(n)).select(
            F.element_at(g_arr, (F.col("id") / int(n)).cast("int") + 1).alias(group_col),
            (F.col("id") % int(n)).alias("draw"))
    draws = draws.withColumn(
        "_id", F.floor(hash_uniform(seed, group_col, "draw") * n_pop).cast("bigint"))
    return draws.join(pop, "_id", "inner").drop("_id")


def choose_many(df: DataFrame, specs: list[tuple], key: str, by=None) -> DataFrame:
    """Flag rows for several independent choices in one pass.

    ``specs`` = [(out, cond, share, seed), ...]. For each spec, exactly
    ``floor(n_group * share)`` rows meeting ``cond`` get ``out`` = true per
    group (n_group counts all rows of the group), taken in hash order; when
    fewer rows meet ``cond``, none is flagged. ``share`` may be a Column
    (constant within a group) or a number. One aggregate gives all group
    counts; each spec adds one ranked candidate table joined back on key.
    """
    keys = _by(by)
    const = not keys
    if const:
        df, keys = df.withColumn("_g", F.lit(0)), ["_g"]
    marked = df
    for i, (_, cond, share, _) in enumerate(specs):
        cnd = F.expr(cond) if isinstance(cond, str) else cond
        sh = share if not isinstance(share, (int, float)) else F.lit(float(share))
        marked = marked.withColumn(f"_c{i}", F.coalesce(cnd, F.lit(False))) \
            .withColumn(f"_s{i}", sh.cast("double"))
    need = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(f"_c{i}").alias(f"_a{i}") for i in range(len(specs))])
    out = marked
    for i, (_, _, _, seed) in enumerate(specs):
        cand = marked.where(f"_c{i}").select(*keys, key).withColumn("_h", hash_hex(seed, key))
        ranked = dense_row_number(cand, "_h", key, keys, f"_r{i}").drop("_h")
        out = out.join(ranked, [*keys, key], "left")
    out = out.join(need, keys, "inner")
    drop = ["_n"]
    for i, (name, _, _, _) in enumerate(specs):
        k = F.floor(F.col("_n") * F.col(f"_s{i}"))
        flag = (F.col(f"_c{i}") & (F.col(f"_a{i}") >= k) & F.col(f"_r{i}").isNotNull()
                & (F.col(f"_r{i}") < k))
        out = out.withColumn(name, F.coalesce(flag, F.lit(False)))
        drop += [f"_c{i}", f"_s{i}", f"_a{i}", f"_r{i}"]
    out = out.drop(*drop)
    return out.drop("_g") if const else out


def choose_within(df: DataFrame, cond, share, key: str, seed, by=None,
                  out: str = "chosen") -> DataFrame:
    """Single-choice form of :func:`choose_many`."""
    return choose_many(df, [(out, cond, share, seed)], key, by)
