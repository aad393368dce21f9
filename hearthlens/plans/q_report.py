"""Group reporting queries: county profile (flagship), equity gap, quadrants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthlens.operators import policy
from hearthlens.plans import common
from hearthlens.plans.oracle import PROFILE_CTE, with_clean, with_profile
from hearthlens.plans.registry import register

EQUITY_CTE = """
eq_norm AS (
  SELECT *, (mean_co2_kg_m2 - min(mean_co2_kg_m2) OVER ())
          / (max(mean_co2_kg_m2) OVER () - min(mean_co2_kg_m2) OVER () + 1e-9) AS co2_norm
  FROM profile
),
eq_raw AS (
  SELECT *, fuel_poverty_rate / 100e0 * (1e0 - retrofit_rate / 100e0) * (co2_norm + 0.5e0) AS raw_gap
  FROM eq_norm
),
equity AS (
  SELECT CountyName, total_homes, mean_ber, mean_co2_kg_m2, retrofit_rate, fuel_poverty_rate,
         wall_insulation_rate, roof_insulation_rate,
         round((raw_gap - min(raw_gap) OVER ()) / (max(raw_gap) OVER () - min(raw_gap) OVER () + 1e-9)
               * 100e0, 2) AS equity_gap_score
  FROM eq_raw
)
"""


@register("G01", "county_profile", with_profile("SELECT * FROM profile"))
def county_profile(spark, sf):
    return policy.county_profile(common.clean(spark, sf))


@register("X07", "equity_gap", with_profile(
    "SELECT *, CAST(rank() OVER (ORDER BY equity_gap_score DESC) AS INT) AS equity_gap_rank FROM equity",
    EQUITY_CTE))
def equity_gap(spark, sf):
    return policy.equity_gap(common.profile(spark, sf))


@register("W01", "rank_min_desc", with_profile(
    "SELECT CountyName, pct_EFG, CAST(rank() OVER (ORDER BY pct_EFG DESC) AS INT) AS rank_pct_efg FROM profile"))
def rank_min_desc(spark, sf):
    return common.profile(spark, sf).select(
        "CountyName", "pct_EFG", policy.rank_min_desc("pct_EFG").cast("int").alias("rank_pct_efg"))


@register("E21", "min_max_scale", with_profile(
    "SELECT CountyName, round((fuel_poverty_rate - min(fuel_poverty_rate) OVER ()) / "
    "(max(fuel_poverty_rate) OVER () - min(fuel_poverty_rate) OVER () + 1e-9), 6) AS fp_scaled FROM profile"))
def min_max_scale(spark, sf):
    return common.profile(spark, sf).select(
        "CountyName", F.round(policy.min_max_scale("fuel_poverty_rate"), 6).alias("fp_scaled"))


@register("X09", "priority_quartile", with_profile(
    "SELECT CountyName, equity_gap_score, threshold FROM "
    "(SELECT *, quantile_cont(equity_gap_score, 0.75) OVER () AS threshold FROM equity) "
    "WHERE equity_gap_score >= threshold", EQUITY_CTE))
def priority_quartile(spark, sf):
    return policy.priority_quartile(policy.equity_gap(common.profile(spark, sf))).select(
        "CountyName", "equity_gap_score", "threshold")


@register("X08", "policy_quadrant", with_profile(
    """SELECT CountyName, mean_ber, retrofit_rate,
       CASE WHEN NOT (mean_ber > nat) AND retrofit_rate > ybar THEN 'Leaders'
            WHEN mean_ber > nat AND retrofit_rate > ybar THEN 'In progress'
            WHEN NOT (mean_ber > nat) AND NOT (retrofit_rate > ybar) THEN 'Efficient stock'
            ELSE 'Priority targets' END AS quadrant
       FROM (SELECT *, avg(retrofit_rate) OVER () AS ybar FROM profile),
            (SELECT avg(BerRating) AS nat FROM clean)"""))
def policy_quadrant(spark, sf):
    # national row mean from the same aggregate pass: sum and count per group,
    # then totals over the group-level table (no second scan, no join)
    prof = policy.county_profile(common.clean(spark, sf), sort=False,
                                 extra={"__sum": F.sum("BerRating")})
    w = Window.partitionBy()
    nat = F.sum("__sum").over(w) / F.sum("total_homes").over(w)
    q = policy.policy_quadrant(prof, nat)
    return q.select("CountyName", "mean_ber", "retrofit_rate", "quadrant")


@register("X10", "chart_encodings", with_profile(
    """SELECT CountyName,
       round(greatest(total_homes / max(total_homes) OVER () * 2500e0, 80e0), 6) AS bubble_size,
       round((fuel_poverty_rate - min(fuel_poverty_rate) OVER ())
             / (max(fuel_poverty_rate) OVER () - min(fuel_poverty_rate) OVER () + 1e-9), 6) AS colour_norm
       FROM profile"""))
def chart_encodings(spark, sf):
    e = policy.chart_encodings(common.profile(spark, sf))
    return e.select("CountyName", F.round("bubble_size", 6).alias("bubble_size"),
                    F.round("colour_norm", 6).alias("colour_norm"))


@register("G04", "global_stats", with_profile(
    """SELECT count(*) AS groups, CAST(sum(total_homes) AS BIGINT) AS total_homes,
       round(avg(mean_ber), 6) AS mean_of_group_means,
       (SELECT CountyName FROM profile ORDER BY mean_ber, CountyName LIMIT 1) AS best_group,
       (SELECT CountyName FROM profile ORDER BY mean_ber DESC, CountyName DESC LIMIT 1) AS worst_group,
       max(retrofit_rate) AS max_retrofit_rate, min(retrofit_rate) AS min_retrofit_rate,
       max(fuel_poverty_rate) AS max_fuel_poverty_rate
       FROM profile"""))
def global_stats(spark, sf):
    g = policy.global_stats(common.profile(spark, sf))
    return g.withColumn("mean_of_group_means", F.round("mean_of_group_means", 6))


@register("G17", "group_sum_to_unit", with_clean(
    "SELECT CountyName, round(sum(Total_Annual_CO2_Tonnes) / 1000e0, 6) AS total_co2_kt FROM clean GROUP BY CountyName"))
def group_sum_to_unit(spark, sf):
    return (common.clean(spark, sf).groupBy("CountyName")
            .agg(F.round(F.sum("Total_Annual_CO2_Tonnes") / 1000.0, 6).alias("total_co2_kt")))


@register("T01", "sort_desc", with_profile("SELECT CountyName, mean_ber FROM profile ORDER BY mean_ber DESC, CountyName"))
def sort_desc(spark, sf):
    return common.profile(spark, sf).select("CountyName", "mean_ber").orderBy(F.desc("mean_ber"), "CountyName")


@register("T02", "top_k", with_profile(
    "SELECT CountyName, fuel_poverty_rate FROM profile ORDER BY fuel_poverty_rate DESC, CountyName LIMIT 5"))
def top_k(spark, sf):
    # the limit is the feature (a top-5 report): planned as TakeOrderedAndProject
    return (common.profile(spark, sf).select("CountyName", "fuel_poverty_rate")
            .orderBy(F.desc("fuel_poverty_rate"), "CountyName").limit(5))
