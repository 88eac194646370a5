"""Quality rules: robust multivariate outliers of text statistics.

Exact counts are taken from every whole text. Six transformed statistics per
document are then compared with the other documents of its language and source:
a minimum-covariance-determinant estimate of centre and scatter is found by
concentration steps over all documents (each step keeps the ``core`` share with
the smallest Mahalanobis distances, per group, and re-estimates from them), and
documents beyond a chi-square quantile of the squared distance are rejected.

Every step is a grouped aggregate with partial sums, so a source that holds a
third of the rows costs what its share of the scan costs. The group table has
one row per language and source.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import Words, slices, stage, text_buffer

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_upper", "n_letters"]
STATS = ["x0", "x1", "x2", "x3", "x4", "x5"]
#: Least spread of each statistic: most documents have no symbol and no repeat at
#: all, and a statistic that never varies in the core must not reject the first that does, yet
#: each must be able to pass the cut-off by itself (x3 from 29 % repeated lines on).
FLOOR = [0.08, 0.5, 0.25, 0.08, 0.066, 0.04]
REPEAT_WORDS = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _first_seen(key: np.ndarray) -> np.ndarray:
    """Mask of the values whose equal does not occur earlier in the array."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(key), bool)
    out[order] = new
    return out


def _occurs_twice(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(key), bool)
    out[order] = same[:-1] | same[1:]
    return out


def text_counts(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a slice (UTF-8 bytes and row offsets)."""
    w = Words(raw, offs)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offs])

    out = {"n_words": w.n_words.astype(np.int64),
           "word_chars": total(w.solid & ((raw & 0xC0) != 0x80)),
           "n_symbols": total(_SYMBOL[raw]), "n_upper": total(_UPPER[raw]),
           "n_letters": total(_LETTER[raw])}
    # lines: from a text's start or a line feed to the next line feed or the text's end
    feeds = np.flatnonzero(raw == 10)
    lo = np.sort(np.concatenate([offs[:-1], feeds + 1]))
    hi = np.sort(np.concatenate([offs[1:], feeds]))
    row_of = np.repeat(np.arange(len(offs) - 1), 1 + np.diff(np.searchsorted(feeds, offs)))
    words_before = np.concatenate([[0], np.cumsum(w.solid, dtype=np.int64)])
    real = words_before[hi] > words_before[lo]
    lo, hi, row_of = lo[real], hi[real], row_of[real]
    salt = row_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    repeated = ~_first_seen(w.span_hash(lo, hi) + salt)
    out["n_lines"] = np.bincount(row_of, minlength=len(offs) - 1).astype(np.int64)
    out["n_dup_lines"] = np.bincount(row_of[repeated], minlength=len(offs) - 1).astype(np.int64)
    # words in windows that occur twice in their text
    gram, valid = w.grams(REPEAT_WORDS)
    at = np.flatnonzero(valid)
    word_row = np.repeat(np.arange(len(offs) - 1), w.n_words)
    key = gram[at] + word_row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at = at[_occurs_twice(key)]
    cover = np.zeros(len(gram) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WORDS, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0, dtype=np.int64)])
    out["n_repeat_words"] = np.diff(covered[w.row0])
    return out


def document_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of each whole text (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = text_counts(*text_buffer(b.column(3)))
            cols = [b.column(0), b.column(1), b.column(2), *(pa.array(got[c]) for c in COUNTS)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "source", *COUNTS])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, schema)


def _statistics() -> list[Column]:
    """Transformed statistics: rates on scales where ordinary text is near symmetric."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log((F.col("word_chars") + 1) / n),
        F.log1p(n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
        F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. to the model columns m0.., p_i_j."""
    d = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(STATS)]
    terms = [F.col(f"p_{i}_{j}") * d[i] * d[j] * (1 if i == j else 2)
             for i in range(len(d)) for j in range(i, len(d))]
    return reduce(lambda a, b: a + b, terms)


def _precision(moments: DataFrame) -> DataFrame:
    """Centre and inverse scatter per group from counts, sums and products."""
    k = len(STATS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                mean = np.array([getattr(r, f"s{i}") for i in range(k)]) / r.n
                cov = np.zeros((k, k))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = getattr(r, f"c_{i}_{j}") / r.n - mean[i] * mean[j]
                inv = np.linalg.inv(cov + np.diag(np.square(FLOOR)))
                rows.append([r.glang, r.gsource, r.rows, *mean, *(inv[i, j] for i, j in pairs)])
            yield pd.DataFrame(rows, columns=names)

    names = (["glang", "gsource", "rows"] + [f"m{i}" for i in range(k)]
             + [f"p_{i}_{j}" for i, j in pairs])
    schema = ", ".join(f"{c} {'string' if c[0] == 'g' else 'long' if c == 'rows' else 'double'}"
                       for c in names)
    return moments.mapInPandas(run, schema)


def _same_group(a: str, b: str) -> Column:
    return (F.col(f"{a}.glang").eqNullSafe(F.col(f"{b}.glang"))
            & F.col(f"{a}.gsource").eqNullSafe(F.col(f"{b}.gsource")))


def fit(grouped: DataFrame, core: float = 0.75, steps: int = 3) -> DataFrame:
    """One model row per (glang, gsource): centre, inverse scatter, rows, distance scale."""
    k = len(STATS)
    keys = ["glang", "gsource"]
    start = grouped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, x in enumerate(STATS)))
    model = start.select(
        *keys, "rows", *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(k)),
        *((1 / (F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOOR[i] ** 2) if i == j
           else F.lit(0.0)).alias(f"p_{i}_{j}") for i in range(k) for j in range(i, k)))
    for step in range(steps + 1):
        model = stage(model, f"mcd-model-{step}")
        near = grouped.alias("g").join(model.alias("m"), _same_group("g", "m")).select(
            "g.*", "rows", _distance().alias("d2"))
        cut = near.groupBy(*keys).agg(F.percentile_approx("d2", [0.5, core], 1000).alias("q"))
        if step == steps:
            median = k * (1 - 2 / (9 * k)) ** 3  # of a chi-square variable
            return model.alias("m").join(cut.alias("c"), _same_group("m", "c")).select(
                "m.*", F.greatest(F.col("q")[0] / median, F.lit(1.0)).alias("scale"))
        kept = near.alias("n").join(cut.alias("c"), _same_group("n", "c")).where(
            F.col("d2") <= F.col("q")[1]).select("n.*")
        model = _precision(kept.groupBy(*keys).agg(
            F.max("rows").alias("rows"), F.count(F.lit(1)).alias("n"),
            *(F.sum(x).alias(f"s{i}") for i, x in enumerate(STATS)),
            *(F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"c_{i}_{j}")
              for i in range(k) for j in range(i, k))))
    raise AssertionError


def cutoff(quantile_z: float) -> float:
    """Chi-square quantile (Wilson-Hilferty) at a standard normal deviate."""
    k = len(STATS)
    return k * (1 - 2 / (9 * k) + quantile_z * (2 / (9 * k)) ** 0.5) ** 3


def judge(docs: DataFrame, quantile: float = 1 - 1e-7, min_rows: int = 50) -> DataFrame:
    """Counts, ``base_failed``, squared distance ``d2`` and ``kept`` per document.

    Documents that fail the base rule (under 10 words, or over a fifth of the
    words in repeated 5-word windows) are left out of the estimates. Groups with
    fewer than ``min_rows`` others, null languages and null sources included,
    are judged against the estimate over all documents. Null and empty texts
    have zero counts and fail the base rule; repeated rows are judged each; an
    empty table gives an empty table; other columns are ignored.
    """
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    counts = document_counts(docs).withColumn(
        "base_failed", (n < 10) | (100 * rep > 20 * n))
    counts = stage(counts.select("*", *(c.alias(x) for c, x in zip(_statistics(), STATS))),
                   "quality-counts")
    own = counts.where(~F.col("base_failed")).select(
        F.concat(F.lit("="), "lang").alias("glang"), F.concat(F.lit("="), "source").alias("gsource"), *STATS)
    everyone = own.withColumn("glang", F.lit("*")).withColumn("gsource", F.lit("*"))
    model = stage(fit(own.unionByName(everyone)), "mcd")
    use = [c for c in model.columns if c not in ("glang", "gsource")]
    # every group of the table names its own model row, or the one over all documents
    ours = model.where((F.col("glang") != "*") & (F.col("rows") >= min_rows)).select("glang", "gsource")
    groups = counts.groupBy("lang", "source").count()
    groups = groups.join(ours, (F.concat(F.lit("="), "lang") == ours["glang"])
                         & (F.concat(F.lit("="), "source") == ours["gsource"]), "left").select(
        "lang", "source", F.coalesce("glang", F.lit("*")).alias("glang"),
        F.when(F.col("glang").isNull(), "*").otherwise(F.col("gsource")).alias("gsource"))
    groups = groups.join(model, ["glang", "gsource"]).select("lang", "source", *use)
    joined = counts.alias("c").join(
        groups.alias("g"), F.col("c.lang").eqNullSafe(F.col("g.lang"))
        & F.col("c.source").eqNullSafe(F.col("g.source")), "left").select("c.*", *use)
    limit = cutoff(NormalDist().inv_cdf(quantile))
    return joined.select(
        *counts.columns, (_distance() / F.col("scale")).alias("d2")).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= limit))
