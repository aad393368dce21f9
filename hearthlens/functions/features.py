"""Scalar feature expressions.

Every function takes column names or ``Column`` objects and returns a
``Column``; nothing here runs a job.  All are built-in Spark expressions so
they stay inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlens import config

__all__ = [
    "col_", "safe_ratio", "weighted_sum_pairs", "ratio_or_numerator",
    "weighted_average_fallback", "row_sum", "bin_right_closed", "bin_left_closed",
    "age_band", "rating_grade", "threshold_flag", "flag_any_of", "flag_yes",
    "map_with_default", "co2_factor", "co2_intensity", "co2_total_tonnes",
    "any_flag", "all_flag", "hes_flag", "contains_ci", "in_set", "clip_lower",
    "case_default", "log1p_target", "expm1_clipped", "round_half_even",
    "round_half_up", "clean_text", "strip_all", "nan_to_null", "to_byte",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_byte(cond: Column) -> Column:
    """Boolean -> 0/1 byte; a null condition counts as 0 (pandas mask semantics)."""
    return F.coalesce(cond, F.lit(False)).cast("tinyint")


def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


# E01 -----------------------------------------------------------------------
def safe_ratio(num, den, default: float = 0.0) -> Column:
    """num / den when den > 0 else ``default`` (ANSI-safe: guard before divide)."""
    num, den = col_(num), col_(den)
    return F.when(den > 0, num / den).otherwise(F.lit(float(default)))


# E02 -----------------------------------------------------------------------
def weighted_sum_pairs(pairs: Sequence[tuple[str, str]] = tuple(config.FABRIC_PAIRS)) -> Column:
    """Sum of value * weight over column pairs; null in any pair gives null."""
    return reduce(add, [col_(u) * col_(a) for u, a in pairs])


# E03 -----------------------------------------------------------------------
def ratio_or_numerator(num, den) -> Column:
    """num / den when den > 0, else the numerator itself."""
    num, den = col_(num), col_(den)
    return F.when(den > 0, num / den).otherwise(num)


# E04 -----------------------------------------------------------------------
def weighted_average_fallback(values: Sequence[str], weights: Sequence[str], fallback) -> Column:
    """Weight-averaged value when the weights sum above zero, else ``fallback``."""
    total = reduce(add, [col_(w) for w in weights])
    num = reduce(add, [col_(v) * col_(w) for v, w in zip(values, weights)])
    return F.when(total > 0, num / total).otherwise(col_(fallback))


# E05 -----------------------------------------------------------------------
def row_sum(cols: Iterable) -> Column:
    return reduce(add, [col_(c) for c in cols])


# E06 -----------------------------------------------------------------------
def bin_right_closed(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of (edges[i], edges[i+1]]; outside every interval or null -> null."""
    c = col_(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(None).cast("string"))


def age_band(c="Year_of_Construction") -> Column:
    return bin_right_closed(c, config.AGE_EDGES, config.AGE_LABELS)


# E07 -----------------------------------------------------------------------
def bin_left_closed(c, bands: Sequence[tuple[float, float, str]], below: str | None = None,
                    above: str | None = None) -> Column:
    """Label of [lo, hi); values below the first band -> ``below`` (else the
    first label, the clip-at-zero rule), above the last -> ``above`` (else the
    last label).  Null stays null."""
    c = col_(c)
    first, last = bands[0], bands[-1]
    expr = F.when(c.isNull(), F.lit(None).cast("string"))
    expr = expr.when(c < first[0], F.lit(below if below is not None else first[2]))
    for lo, hi, lab in bands:
        expr = expr.when((c >= lo) & (c < hi), F.lit(lab))
    return expr.otherwise(F.lit(above if above is not None else last[2]))


def rating_grade(c="BerRating") -> Column:
    return bin_left_closed(c, config.GRADE_BANDS)


# E08 -----------------------------------------------------------------------
def threshold_flag(c, limit: float, op: str = "<=") -> Column:
    """0/1 flag of ``c <op> limit``; null input -> 0."""
    c = col_(c)
    cond = {"<=": c <= limit, "<": c < limit, ">": c > limit, ">=": c >= limit}[op]
    return to_byte(cond)


# P11 / P12 -----------------------------------------------------------------
def contains_ci(c, needle: str) -> Column:
    """Case-insensitive substring test; null -> false."""
    return F.coalesce(F.lower(col_(c)).contains(needle.lower()), F.lit(False))


def in_set(c, values: Sequence) -> Column:
    """Membership; null -> false."""
    return F.coalesce(col_(c).isin(list(values)), F.lit(False))


# E09 -----------------------------------------------------------------------
def flag_any_of(*conds: Column) -> Column:
    return to_byte(reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in conds]))


# E10 -----------------------------------------------------------------------
def flag_yes(c, tokens: Sequence[str] = tuple(config.YES_TOKENS)) -> Column:
    return to_byte(F.upper(col_(c)).isin(list(tokens)))


# E11 -----------------------------------------------------------------------
def map_with_default(c, mapping: dict, default) -> Column:
    """Literal map lookup with a default (for small fixed maps)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.trim(col_(c))), F.lit(default))


def co2_factor(fuel="MainSpaceHeatingFuel") -> Column:
    return map_with_default(fuel, config.CO2_FACTORS, config.DEFAULT_CO2_FACTOR)


# E12 -----------------------------------------------------------------------
def co2_intensity(rating="BerRating", fuel="MainSpaceHeatingFuel") -> Column:
    return col_(rating) * co2_factor(fuel)


def co2_total_tonnes(intensity, area="FloorArea") -> Column:
    """intensity * max(area, 0) / 1000; null area -> null (``greatest`` alone would skip it)."""
    area = col_(area)
    return F.when(area.isNull(), F.lit(None).cast("double")).otherwise(
        col_(intensity) * F.greatest(area, F.lit(0.0)) / 1000.0)


# E13 / E14 -----------------------------------------------------------------
def any_flag(*flags) -> Column:
    return to_byte(reduce(lambda a, b: a | b, [F.coalesce(col_(f).cast("boolean"), F.lit(False)) for f in flags]))


def all_flag(*conds: Column) -> Column:
    return to_byte(reduce(lambda a, b: a & b, conds))


def hes_flag(c="HESSchemeUpgrade") -> Column:
    """Scheme-upgrade text flag: true for any non-empty value other than
    no / none / 0 / 0.0 (after trim, case-insensitive); null -> false."""
    v = F.lower(F.trim(col_(c).cast("string")))
    return F.coalesce(~v.isin(config.HES_FALSE_TOKENS), F.lit(False))


# P13 / P14 -----------------------------------------------------------------
def clip_lower(c, lower: float = 0.0) -> Column:
    c = col_(c)
    return F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(lower)))


def case_default(cond: Column, then, otherwise) -> Column:
    return F.when(cond, then).otherwise(otherwise)


# E15 -----------------------------------------------------------------------
def log1p_target(c) -> Column:
    return F.log1p(col_(c))


def expm1_clipped(c, lower: float = 0.0) -> Column:
    return clip_lower(F.expm1(col_(c)), lower)


# E16 -----------------------------------------------------------------------
def round_half_even(c, scale: int) -> Column:
    return F.bround(col_(c), scale)


def round_half_up(c, scale: int) -> Column:
    return F.round(col_(c), scale)


# C01 / E23 -----------------------------------------------------------------
def clean_text(c) -> Column:
    """Strip blanks at both ends (``trim``)."""
    return F.trim(col_(c))


def strip_all(c) -> Column:
    """Strip all ASCII whitespace (pandas ``str.strip``)."""
    return F.btrim(col_(c), F.lit(" \t\r\n\x0b\x0c"))
