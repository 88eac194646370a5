"""Production-month perturbations: noise, scenario shifts, reassignment, flips.

All random choices are hashes of (seed, key, column), so a retried task or
another engine perturbs the same rows by the same amounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.functions.columns import hash_uniform
from orderpulse.sources.local import literal_table
from orderpulse.operators.sampling import choose_many, choose_within

# The drift scenario by month (months without a row are
# unchanged): days added to delivery_days, freight multiplier, share of
# rows moved to 'electronics', share of rows whose positive label flips.
SCENARIO = [
    (4, 2.0, 1.15, 0.10, 0.05),
    (5, 4.0, 1.30, 0.15, 0.05),
    (6, 6.0, 1.50, 0.20, 0.05),
]
SCENARIO_SCHEMA = ("month int, delivery_add double, freight_mult double, "
                   "electronics_shift_pp double, flip_pct double")
NOISE_PCT = 0.05
FREIGHT_COLS = ["total_freight_value", "avg_freight_value", "max_freight_value"]
SHIFT_TO = "electronics"


def scenario_table(spark: SparkSession, rows=None) -> DataFrame:
    return literal_table(spark, rows or SCENARIO, SCENARIO_SCHEMA)


def jitter(df: DataFrame, cols: list[str], pct: float, key: str, seed=42) -> DataFrame:
    """x * (1 + U(-pct, pct)), independent per row and column; NULL stays NULL."""
    out = df
    for c in cols:
        u = hash_uniform(seed, key, F.lit(c))
        out = out.withColumn(c, F.col(c).cast("double") * (F.lit(1.0) + (F.lit(2.0) * u - 1.0)
                                                          * F.lit(pct)))
    return out


def apply_scenario(df: DataFrame, scenario: DataFrame, by: str = "month",
                   shift_col: str = "delivery_days", mult_cols=None) -> DataFrame:
    """Additive shift on ``shift_col`` and multiplicative on ``mult_cols``.

    The scenario table has one row per month (small): left join.
    Its ``electronics_shift_pp`` and ``flip_pct`` columns stay on the rows
    for :func:`reassign_category` and :func:`flip_labels`.
    """
    mult_cols = mult_cols or FREIGHT_COLS
    j = df.join(scenario, by, "left")
    j = j.withColumn(shift_col, F.col(shift_col) + F.coalesce("delivery_add", F.lit(0.0)))
    for c in mult_cols:
        j = j.withColumn(c, F.col(c) * F.coalesce("freight_mult", F.lit(1.0)))
    return j.drop("delivery_add", "freight_mult")


def reassign_category(df: DataFrame, col: str, to: str, share, key: str, seed=42,
                      by: str = "month") -> DataFrame:
    """Set ``int(n * share)`` rows whose ``col`` is not ``to`` (NULL counts as
    not ``to``) to ``to``, per group; skipped when too few such rows exist."""
    cond = F.col(col).isNull() | (F.col(col) != F.lit(to))
    chosen = choose_within(df, cond, share, key, f"{seed}:reassign", by, "_chosen")
    return chosen.withColumn(col, F.when(F.col("_chosen"), F.lit(to)).otherwise(F.col(col))) \
        .drop("_chosen")


def flip_labels(df: DataFrame, label: str, share, key: str, seed=42,
                by: str = "month") -> DataFrame:
    """``int(n * share)`` positive labels per group become 0 (share of ALL rows)."""
    chosen = choose_within(df, F.col(label) == 1, share, key, f"{seed}:flip", by, "_chosen")
    return chosen.withColumn(label, F.when(F.col("_chosen"), F.lit(0)).otherwise(F.col(label))) \
        .drop("_chosen")


def drift_months(df: DataFrame, scenario: DataFrame, numeric: list[str], label: str,
                 key: str, seed=42, by: str = "month", noise: float = NOISE_PCT) -> DataFrame:
    """Noise on every month, then the scenario's shifts, reassignment and flips.

    Reassignment and flips are independent choices (different candidate
    sets), so both are ranked in one pass over the shifted rows.
    """
    out = jitter(df, numeric, noise, key, seed)
    out = apply_scenario(out, scenario, by)
    cat = "product_category"
    specs = [
        ("_move", F.col(cat).isNull() | (F.col(cat) != F.lit(SHIFT_TO)),
         F.coalesce("electronics_shift_pp", F.lit(0.0)), f"{seed}:reassign"),
        ("_flip", F.col(label) == 1, F.coalesce("flip_pct", F.lit(0.0)), f"{seed}:flip"),
    ]
    out = choose_many(out, specs, key, by)
    out = (out.withColumn(cat, F.when(F.col("_move"), F.lit(SHIFT_TO)).otherwise(F.col(cat)))
           .withColumn(label, F.when(F.col("_flip"), F.lit(0)).otherwise(F.col(label))))
    return out.drop("_move", "_flip", "electronics_shift_pp", "flip_pct")
