"""Group reporting and policy scores.

The group tables have one row per county (tens of rows, bounded by the number
of distinct group values, not by the data volume).  Global windows below run
only on such group-level tables, never on row-level data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlens.functions.features import col_

RATE_COLUMNS = {
    "retrofit_rate": "is_retrofitted",
    "fuel_poverty_rate": "fuel_poverty_risk",
    "wall_insulation_rate": "wall_insulated",
    "roof_insulation_rate": "roof_insulated",
    "heating_upgrade_rate": "heating_upgraded",
}


def _round(c: Column, scale: int, half_even: bool) -> Column:
    return F.bround(c, scale) if half_even else F.round(c, scale)


def share_where(cond: Column) -> Column:
    """Share of all rows (nulls count as 'no') -- pandas ``mask.mean()``."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


# G01 -----------------------------------------------------------------------
def county_profile(df: DataFrame, group: str = "CountyName", target: str = "BerRating",
                   co2: str = "EstCO2_kg_per_m2", co2_total: str = "Total_Annual_CO2_Tonnes",
                   good_max: float = 100.0, poor_min: float = 300.0, approx_median: bool = False,
                   half_even: bool = False, sort: bool = True, extra: dict | None = None) -> DataFrame:
    """Twelve metrics per group, rounded, worst mean first.

    One hash aggregate: partial aggregation map-side, so a hot county (a
    third of all rows) is pre-combined per partition before the shuffle and the
    final aggregate sees one partial row per partition.  The exact median
    comes from the distributed counting quantile (``operators.quantiles``);
    ``approx_median`` switches to ``percentile_approx`` in the same aggregate.
    """
    t = F.col(target)
    aggs = [
        F.count(t).alias("total_homes"),
        F.avg(t).alias("mean_ber"),
        (share_where(t <= good_max) * 100.0).alias("pct_AB"),
        (share_where(t > poor_min) * 100.0).alias("pct_EFG"),
        F.avg(co2).alias("mean_co2_kg_m2"),
        (F.sum(co2_total) / 1000.0).alias("total_co2_kt"),
    ] + [(F.avg(F.col(src).cast("double")) * 100.0).alias(name) for name, src in RATE_COLUMNS.items()]
    extra = extra or {}
    if approx_median:
        aggs.append(F.percentile_approx(t, 0.5, 10000).alias("median_ber"))
    prof = df.groupBy(group).agg(*aggs, *[e.alias(n) for n, e in extra.items()])
    if not approx_median:
        # exact median by distributed counting (bounded task memory even for
        # a county holding a third of all rows), joined per group
        from hearthlens.operators.quantiles import group_quantiles
        from hearthlens.operators.relational import join_groups
        prof = join_groups(prof, group_quantiles(df, [group], target, [0.5], ["median_ber"]), [group])
    r = lambda c, s: _round(F.col(c), s, half_even)
    prof = prof.select(
        group, "total_homes",
        r("mean_ber", 1).alias("mean_ber"), r("median_ber", 1).alias("median_ber"),
        r("pct_AB", 1).alias("pct_AB"), r("pct_EFG", 1).alias("pct_EFG"),
        r("mean_co2_kg_m2", 2).alias("mean_co2_kg_m2"), r("total_co2_kt", 1).alias("total_co2_kt"),
        *[r(c, 2).alias(c) for c in RATE_COLUMNS], *extra.keys())
    return prof.orderBy(F.desc("mean_ber"), group) if sort else prof


# E21 -----------------------------------------------------------------------
def min_max_scale(c, eps: float = 1e-9, over: Window | None = None) -> Column:
    """(x - min) / (max - min + eps) over a group-level table."""
    w = over if over is not None else Window.partitionBy()
    c = col_(c)
    lo = F.min(c).over(w)
    return (c - lo) / (F.max(c).over(w) - lo + F.lit(eps))


# W01 -----------------------------------------------------------------------
def rank_min_desc(c, over_partition: list[str] | None = None) -> Column:
    """Competition rank (1 = largest; ties share the smallest rank)."""
    w = Window.partitionBy(*(over_partition or [])).orderBy(F.desc(col_(c)))
    return F.rank().over(w)


# X07 -----------------------------------------------------------------------
def equity_gap(profile: DataFrame, group: str = "CountyName", offset: float = 0.5,
               half_even: bool = False) -> DataFrame:
    """fp x (1 - retrofit) x (co2 min-max + offset), min-max scaled to 0-100, ranked.

    Input is the *rounded* county profile, as in the original report chain.
    """
    fp = F.col("fuel_poverty_rate") / 100.0
    rr = F.col("retrofit_rate") / 100.0
    scored = profile.withColumn("__raw", fp * (1.0 - rr) * (min_max_scale("mean_co2_kg_m2") + F.lit(offset)))
    scored = scored.withColumn("equity_gap_score",
                               _round(min_max_scale("__raw") * 100.0, 2, half_even))
    scored = scored.withColumn("equity_gap_rank", rank_min_desc("equity_gap_score").cast("int"))
    return scored.select(group, "total_homes", "mean_ber", "mean_co2_kg_m2", "retrofit_rate",
                         "fuel_poverty_rate", "wall_insulation_rate", "roof_insulation_rate",
                         "equity_gap_score", "equity_gap_rank")


# X09 -----------------------------------------------------------------------
def priority_quartile(scores: DataFrame, score: str = "equity_gap_score", q: float = 0.75) -> DataFrame:
    """Groups at or above the q-quantile (linear interpolation) of the score."""
    w = Window.partitionBy()
    return (scores.withColumn("threshold", F.percentile(F.col(score), q).over(w))
                  .where(F.col(score) >= F.col("threshold")))


# X08 -----------------------------------------------------------------------
def policy_quadrant(profile: DataFrame, national_mean: float | Column,
                    x: str = "mean_ber", y: str = "retrofit_rate") -> DataFrame:
    """Four labels: rating against the national mean x retrofit rate against
    the mean of the group rates."""
    ybar = F.avg(F.col(y)).over(Window.partitionBy())
    nat = national_mean if isinstance(national_mean, Column) else F.lit(float(national_mean))
    high_x = F.col(x) > nat
    high_y = F.col(y) > ybar
    label = (F.when(~high_x & high_y, "Leaders").when(high_x & high_y, "In progress")
              .when(~high_x & ~high_y, "Efficient stock").otherwise("Priority targets"))
    return profile.withColumn("quadrant", label)


# X10 -----------------------------------------------------------------------
def chart_encodings(profile: DataFrame, size_col: str = "total_homes", colour_col: str = "fuel_poverty_rate",
                    max_size: float = 2500.0, min_size: float = 80.0) -> DataFrame:
    """Bubble size (relative to the largest group, floored) and colour scale."""
    w = Window.partitionBy()
    size = F.greatest(F.col(size_col) / F.max(size_col).over(w) * max_size, F.lit(min_size))
    return profile.withColumns({"bubble_size": size, "colour_norm": min_max_scale(colour_col)})


# G04 -----------------------------------------------------------------------
def global_stats(profile: DataFrame, group: str = "CountyName") -> DataFrame:
    """National summary of a group table (one row)."""
    return profile.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("total_homes").alias("total_homes"),
        F.avg("mean_ber").alias("mean_of_group_means"),
        F.min_by(group, F.struct(F.col("mean_ber"), F.col(group))).alias("best_group"),
        F.max_by(group, F.struct(F.col("mean_ber"), F.col(group))).alias("worst_group"),
        F.max("retrofit_rate").alias("max_retrofit_rate"),
        F.min("retrofit_rate").alias("min_retrofit_rate"),
        F.max("fuel_poverty_rate").alias("max_fuel_poverty_rate"),
    )
