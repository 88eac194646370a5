"""Column expressions shared by the operators (JVM-side; the exact KS p-value, of a few
rows per report, is a Pandas UDF)."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0

# Drift severity thresholds and labels (PSI < 0.1 stable,
# < 0.2 moderate, otherwise significant).
PSI_YELLOW = 0.1
PSI_RED = 0.2
SEVERITY_GREEN = "GREEN"
SEVERITY_YELLOW = "YELLOW"
SEVERITY_RED = "RED"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_days(later, earlier) -> Column:
    """Whole elapsed 24-hour periods, floored (-23 h -> -1).

    Calendar-day counting (``datediff``) and truncation toward zero
    (``timestampdiff(DAY)``) both differ from this on partial days.
    """
    micros = F.timestamp_diff("MICROSECOND", col_(earlier), col_(later))
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("double")


def nan_to_null(c) -> Column:
    """Missing doubles are NULL, never NaN (NaN sorts largest and poisons avg)."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def hash_hex(seed, *cols) -> Column:
    """md5 of ``seed:c1:c2...``: stable across engines, layouts and retries."""
    parts = [F.lit(str(seed))] + [col_(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_uniform(seed, *cols) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of :func:`hash_hex`
    (as many as a double holds, so draws reach every row of any table)."""
    h = hash_hex(seed, *cols)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


# The characters Python's ``str.strip`` removes (str.isspace),
# in code point order: U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0,
# U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
STRIP_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def strip_unicode(c) -> Column:
    """``str.strip()`` semantics; plain ``trim`` removes only U+0020. Trims
    the character set from both ends only: whole texts are never scanned."""
    return F.trim(col_(c), F.lit(STRIP_CHARS))


def preview(c, n: int = 60) -> Column:
    """First ``n`` characters and an ellipsis when the text is longer."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def parse_stars(label) -> Column:
    """``"4 stars"`` / ``"1 star"`` -> 4 / 1; anything else -> NULL. Words are
    separated by any white space, also at the start."""
    return F.split(strip_unicode(label), r"\s+").getItem(0).try_cast("int")


def stars_label(stars) -> Column:
    s = col_(stars)
    return F.when(s == 1, F.lit("1 star")).otherwise(F.concat(s.cast("string"), F.lit(" stars")))


def binarize(c, cutoff: float = 4) -> Column:
    """Rating >= cutoff -> 1 else 0 (NULL stays NULL)."""
    return (col_(c) >= F.lit(cutoff)).cast("int")


def safe_div(a, b) -> Column:
    """a / b, 0 when the denominator is 0 or NULL (metric convention)."""
    return F.coalesce(F.try_divide(col_(a).cast("double"), col_(b).cast("double")), F.lit(0.0))


def snap(c, digits: int = 6) -> Column:
    """Report precision: half-up at ``digits`` on the binary value.

    Used on floating results whose last bits depend on summation order, so
    two engines print the same number. ``round`` is avoided on purpose: it
    rounds the shortest decimal form, which differs between engines. Values
    whose scaled form has no fraction left (2**53 and more) stay as they are.
    """
    scale, c = float(10 ** digits), col_(c)
    return F.when(F.abs(c * F.lit(scale)) >= float(1 << 53), c.cast("double")).otherwise(
        F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale))


def severity(psi) -> Column:
    """GREEN below 0.1, YELLOW below 0.2, else RED (NaN/NULL compare false -> RED)."""
    p = col_(psi)
    return (F.when(p < PSI_YELLOW, F.lit(SEVERITY_GREEN))
            .when(p < PSI_RED, F.lit(SEVERITY_YELLOW))
            .otherwise(F.lit(SEVERITY_RED)))


def bin_index(value, inner_edges) -> Column:
    """Histogram bin of ``value`` against sorted inner edges, 0-based.

    Bins are ``[e_i, e_{i+1})`` with infinite outer bins; equals numpy's
    ``histogram`` on those edges, also when several edges coincide.
    """
    v = col_(value)
    return F.size(F.filter(col_(inner_edges), lambda e: e <= v))


def linspace_inner(lo, hi, n_bins: int) -> Column:
    """The ``n_bins - 1`` inner edges of ``linspace(lo, hi, n_bins + 1)``."""
    lo, hi = col_(lo), col_(hi)
    step = (hi - lo) / F.lit(float(n_bins))
    return F.transform(F.sequence(F.lit(1), F.lit(n_bins - 1)), lambda i: lo + i * step)


def ks_pvalue(d, n_ref, n_cur) -> Column:
    """Asymptotic two-sample KS p-value (Kolmogorov distribution), in [0, 1].

    With ``l = sqrt(nr * nc / (nr + nc)) * d``: from 1 on the alternating series
    ``2 * sum (-1)^(k-1) exp(-2 k^2 l^2)``, below 1 its theta transform
    ``1 - sqrt(2 pi) / l * sum exp(-(2k-1)^2 pi^2 / (8 l^2))``. Either converges
    to double precision in a few terms on its side. NULL when ``d`` is.
    """
    d, nr, nc = col_(d), col_(n_ref).cast("double"), col_(n_cur).cast("double")
    lam = F.sqrt(nr * nc / (nr + nc)) * d
    terms = range(1, 9)
    tail = reduce(add, [F.lit(2.0 if k % 2 else -2.0) * F.exp(F.lit(-2.0 * k * k) * lam * lam) for k in terms])
    body = reduce(add, [F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi ** 2 / 8) / (lam * lam)) for k in terms])
    p = F.when(lam >= 1, tail).otherwise(F.lit(1.0) - F.lit(math.sqrt(2 * math.pi)) / lam * body)
    return F.when(d <= 0, F.lit(1.0)).when(d.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def ks_exact_pvalue(d, n_ref, n_cur) -> Column:
    """Exact two-sample KS p-value: the share of all orders of the two samples'
    values whose statistic is ``d`` or more.

    An order is a lattice path from (0, 0) to (n_ref, n_cur); its statistic
    reaches ``d`` where the path leaves the band |i / n_ref - j / n_cur| < d. The
    chance to be inside the band is carried along the diagonals i + j = k, and
    what leaves it adds up to the p-value. Work is n_ref * n_cur per row: meant
    for one row per group and samples up to about 10,000. NULL in, NULL out."""

    @F.pandas_udf("double")
    def exact(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(a) or pd.isna(b) or not a or not b
                          else _path_share(float(x), int(a), int(b)) for x, a, b in zip(d, n, m)], dtype="float64")

    return exact(col_(d).cast("double"), col_(n_ref).cast("bigint"), col_(n_cur).cast("bigint"))


def _path_share(d: float, n: int, m: int) -> float:
    """Share of the lattice paths to (n, m) that reach |i * m - j * n| >= d * n * m."""
    reach = round(d * n * m)
    if reach <= 0:
        return 1.0
    inside, left = np.zeros(n + 1), 0.0
    inside[0] = 1.0
    i = np.arange(n + 1)
    for k in range(1, n + m + 1):
        lo, hi = max(0, k - m), min(n, k)
        # drawn without replacement: a step in i with chance (n - i) / (values left), else in j
        rest = n + m - k + 1
        step = np.zeros(n + 1)
        a, b = max(lo, 1), hi + 1
        step[a:b] = inside[a - 1:b - 1] * (n - i[a - 1:b - 1]) / rest
        j = np.maximum(k - 1 - i[lo:hi + 1], -1)
        step[lo:hi + 1] += inside[lo:hi + 1] * np.clip(m - j, 0, None) / rest * (j >= 0)
        out = np.abs(i[lo:hi + 1] * m - (k - i[lo:hi + 1]) * n) >= reach
        left += step[lo:hi + 1][out].sum()
        step[lo:hi + 1][out] = 0.0
        inside = step
    return float(min(1.0, left))


def plus_days_hours(ts, days, hours) -> Column:
    """timestamp + days + hours (interval arithmetic, keeps TIMESTAMP_NTZ)."""
    return col_(ts) + F.make_dt_interval(col_(days).cast("int"), col_(hours).cast("int"),
                                         F.lit(0), F.lit(0))
