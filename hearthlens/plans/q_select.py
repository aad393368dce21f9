"""Projection / filter / set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlens import config
from hearthlens.functions import features as fx
from hearthlens.operators import clean as C
from hearthlens.operators import select as S
from hearthlens.operators import quality as Q
from hearthlens.operators import ml
from hearthlens.plans import common
from hearthlens.plans.oracle import sql_list, with_clean, with_proxy
from hearthlens.plans.registry import register
from hearthlens.sources.tables import DWELLING_KEY

K = ", ".join(DWELLING_KEY)

# Column groups of the proxy table used by the drop rules (config-like data).
PROXY_DROP_GROUPS = {
    "administrative": ["l_partkey", "l_suppkey"],
    "sparse": ["DeclaredLossFactor", "StorageLosses"],
    "outcome": ["HSSupplHeatFraction"],
}
KEEP_LIST = ["l_orderkey", "l_linenumber", "CountyName", "DwellingTypeDescr", "Year_of_Construction",
             "BerRating", "UValueWall", "UValueRoof", "FloorArea"]
RENAMES = {"GroundFloorAreasq_m": "GroundFloorArea", "UvalueDoor": "UValueDoor", "CountyName": "County"}
RAW = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CountyName, DwellingTypeDescr, "
       "Year_of_Construction, BerRating, UValueWall, UValueRoof, UValueFloor, UValueWindow, UvalueDoor, WallArea, "
       "RoofArea, FloorArea, WindowArea, DoorArea, GroundFloorAreasq_m, HSMainSystemEfficiency, HSSupplHeatFraction, "
       "StructureType, NoOfSidesSheltered, MainSpaceHeatingFuel, SolarHotWaterHeating, HESSchemeUpgrade, "
       "DeclaredLossFactor, StorageLosses")


def _cols_except(drop):
    return ", ".join(c.strip() for c in RAW.split(",") if c.strip() not in drop)


@register("P01", "drop_columns", with_proxy(
    f"SELECT {_cols_except([c for g in PROXY_DROP_GROUPS.values() for c in g])} FROM dwellings"))
def drop_columns(spark, sf):
    return S.drop_columns(common.proxy(spark, sf), PROXY_DROP_GROUPS)


@register("P02", "drop_if_present", with_proxy(f"SELECT {_cols_except(['StorageLosses', 'DeclaredLossFactor'])} FROM dwellings"))
def drop_if_present(spark, sf):
    df, _absent = S.drop_if_present(common.proxy(spark, sf), ["StorageLosses", "DeclaredLossFactor", "CO2Rating"])
    return df


@register("P03", "keep_columns", with_proxy(f"SELECT {', '.join(KEEP_LIST)}, l_partkey, l_suppkey, l_quantity FROM dwellings"))
def keep_columns(spark, sf):
    return S.keep_columns(common.proxy(spark, sf), KEEP_LIST + ["l_partkey", "l_suppkey", "l_quantity"])


@register("P04", "rename_columns", with_proxy(
    f"SELECT {K}, GroundFloorAreasq_m AS GroundFloorArea, UvalueDoor AS UValueDoor, CountyName AS County FROM dwellings"))
def rename_columns(spark, sf):
    d = S.rename_columns(common.proxy(spark, sf), RENAMES)
    return d.select(*DWELLING_KEY, "GroundFloorArea", "UValueDoor", "County")


@register("P07", "filter_range", with_proxy(
    f"SELECT {K}, BerRating, Year_of_Construction FROM dwellings "
    "WHERE BerRating BETWEEN 0e0 AND 2000e0 AND Year_of_Construction BETWEEN 1700 AND 2026"))
def filter_range(spark, sf):
    d = C.filter_range(common.proxy(spark, sf), {"BerRating": config.RATING_RANGE,
                                                 "Year_of_Construction": config.YEAR_RANGE})
    return d.select(*DWELLING_KEY, "BerRating", "Year_of_Construction")


@register("P08", "filter_quantile_trim", with_clean(
    f"SELECT {K}, BerRating FROM clean, (SELECT quantile_cont(BerRating, 0.01) AS lo, quantile_cont(BerRating, 0.99) AS hi FROM clean) "
    "WHERE BerRating BETWEEN lo AND hi"))
def filter_quantile_trim(spark, sf):
    return C.quantile_trim(common.clean(spark, sf), "BerRating", 0.01, 0.99).select(*DWELLING_KEY, "BerRating")


@register("P09", "filter_threshold_fallback", with_clean(
    f"SELECT {K}, BerRating FROM clean WHERE BerRating > 200e0 OR (SELECT count(*) FROM clean WHERE BerRating > 200e0) <= 3"))
def filter_threshold_fallback(spark, sf):
    cl = common.clean(spark, sf)
    return S.filter_threshold_fallback(cl, F.col("BerRating") > 200.0, 3).select(*DWELLING_KEY, "BerRating")


@register("P10", "drop_null_rows", with_proxy(
    f"SELECT {K} FROM dwellings WHERE GroundFloorAreasq_m IS NOT NULL AND HSMainSystemEfficiency IS NOT NULL "
    "AND StructureType IS NOT NULL AND MainSpaceHeatingFuel IS NOT NULL"))
def drop_null_rows(spark, sf):
    d = C.drop_null_rows(common.proxy(spark, sf), ["GroundFloorAreasq_m", "HSMainSystemEfficiency",
                                                   "StructureType", "MainSpaceHeatingFuel"])
    return d.select(*DWELLING_KEY)


@register("P11", "predicate_contains_ci", with_proxy(
    f"SELECT {K}, coalesce(contains(lower(MainSpaceHeatingFuel), 'oil'), false) AS is_oil FROM dwellings"))
def predicate_contains_ci(spark, sf):
    return common.proxy(spark, sf).select(*DWELLING_KEY, fx.contains_ci("MainSpaceHeatingFuel", "OIL").alias("is_oil"))


@register("P12", "predicate_in_set", with_clean(
    f"SELECT {K}, coalesce(MainSpaceHeatingFuel IN ({sql_list(config.FUEL_POVERTY_FUELS)}), false) AS high_cost_fuel FROM clean"))
def predicate_in_set(spark, sf):
    return common.clean(spark, sf).select(*DWELLING_KEY, fx.in_set("MainSpaceHeatingFuel", config.FUEL_POVERTY_FUELS)
                                          .alias("high_cost_fuel"))


@register("P13", "clip", with_proxy(
    f"SELECT {K}, CASE WHEN BerRating IS NULL THEN NULL ELSE greatest(BerRating, 0e0) END AS rating_clipped FROM dwellings"))
def clip(spark, sf):
    return common.proxy(spark, sf).select(*DWELLING_KEY, fx.clip_lower("BerRating", 0.0).alias("rating_clipped"))


@register("P14", "case_default", with_proxy(
    f"SELECT {K}, CASE WHEN WallArea > 0 THEN 'has_wall' WHEN WallArea = 0 THEN 'no_wall' ELSE 'unknown' END AS wall_state FROM dwellings"))
def case_default(spark, sf):
    w = F.col("WallArea")
    e = fx.case_default(w > 0, F.lit("has_wall"), fx.case_default(w == 0, F.lit("no_wall"), F.lit("unknown")))
    return common.proxy(spark, sf).select(*DWELLING_KEY, e.alias("wall_state"))


SPLIT_SQL = ("CASE WHEN (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + l_suppkey * 17 + l_quantity) % 100 < 70 "
             "THEN 'train' WHEN (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + l_suppkey * 17 + l_quantity) % 100 < 85 "
             "THEN 'validation' ELSE 'test' END")


@register("U01", "union_rows", with_clean(
    f"SELECT {K}, split FROM (SELECT *, {SPLIT_SQL} AS split FROM clean) WHERE split = 'train' "
    f"UNION ALL SELECT {K}, split FROM (SELECT *, {SPLIT_SQL} AS split FROM clean) WHERE split = 'validation'"))
def union_rows(spark, sf):
    d = common.clean(spark, sf).withColumn("split", ml.split_label(DWELLING_KEY))
    tr = d.where(F.col("split") == "train").select(*DWELLING_KEY, "split")
    va = d.where(F.col("split") == "validation").select(*DWELLING_KEY, "split")
    return S.union_rows(tr, va)


_NULL_SHARE_SQL = None


@register("U02", "union_distinct_names", with_proxy(
    "SELECT column_name FROM (SELECT unnest(['GroundFloorAreasq_m','HSMainSystemEfficiency','HSSupplHeatFraction','StructureType',"
    "'NoOfSidesSheltered','MainSpaceHeatingFuel','SolarHotWaterHeating','HESSchemeUpgrade','StorageLosses']) AS column_name, "
    "unnest([avg(CASE WHEN GroundFloorAreasq_m IS NULL THEN 1e0 ELSE 0e0 END), avg(CASE WHEN HSMainSystemEfficiency IS NULL THEN 1e0 ELSE 0e0 END),"
    " avg(CASE WHEN HSSupplHeatFraction IS NULL THEN 1e0 ELSE 0e0 END), avg(CASE WHEN StructureType IS NULL THEN 1e0 ELSE 0e0 END),"
    " avg(CASE WHEN NoOfSidesSheltered IS NULL THEN 1e0 ELSE 0e0 END), avg(CASE WHEN MainSpaceHeatingFuel IS NULL THEN 1e0 ELSE 0e0 END),"
    " avg(CASE WHEN SolarHotWaterHeating IS NULL THEN 1e0 ELSE 0e0 END), avg(CASE WHEN HESSchemeUpgrade IS NULL THEN 1e0 ELSE 0e0 END),"
    " avg(CASE WHEN StorageLosses IS NULL THEN 1e0 ELSE 0e0 END)]) AS share FROM dwellings) WHERE share > 0.2e0 "
    "UNION SELECT column_name FROM (SELECT unnest(['WallArea','UValueWall','UValueRoof','UValueFloor']) AS column_name, "
    "unnest([avg(CASE WHEN WallArea IS NULL OR WallArea = 0 THEN 1e0 ELSE 0e0 END), avg(CASE WHEN UValueWall IS NULL OR UValueWall = 0 THEN 1e0 ELSE 0e0 END),"
    " avg(CASE WHEN UValueRoof IS NULL OR UValueRoof = 0 THEN 1e0 ELSE 0e0 END), avg(CASE WHEN UValueFloor IS NULL OR UValueFloor = 0 THEN 1e0 ELSE 0e0 END)]) AS share "
    "FROM dwellings) WHERE share > 0.1e0"))
def union_distinct_names(spark, sf):
    d = common.proxy(spark, sf)
    sparse = Q.null_profile(d, ["GroundFloorAreasq_m", "HSMainSystemEfficiency", "HSSupplHeatFraction", "StructureType",
                                "NoOfSidesSheltered", "MainSpaceHeatingFuel", "SolarHotWaterHeating",
                                "HESSchemeUpgrade", "StorageLosses"]).where(F.col("null_share") > 0.2)
    zeros = Q.zero_profile(d, ["WallArea", "UValueWall", "UValueRoof", "UValueFloor"]).where(F.col("zero_share") > 0.1)
    return S.union_distinct_names(sparse.select("column_name"), zeros.select("column_name"))


FEATS = ["UValueWall", "UValueRoof", "UValueFloor", "UValueWindow", "WallArea", "RoofArea", "FloorArea",
         "WindowArea", "GroundFloorAreasq_m", "HSMainSystemEfficiency", "FabricHeatLossProxy", "WindowToWallRatio"]


def _top_corr_sql(target, k):
    sel = ", ".join(f"abs(corr({c}, {target}))" for c in FEATS)
    names = ", ".join(f"'{c}'" for c in FEATS)
    return (f"(SELECT feature FROM (SELECT unnest([{names}]) AS feature, round(unnest([{sel}]), 9) AS r FROM clean) "
            f"ORDER BY r DESC NULLS LAST, feature LIMIT {k})")


@register("U03", "intersect_names", with_clean(
    f"SELECT feature, 'both' AS membership FROM ({_top_corr_sql('BerRating', 5)} INTERSECT {_top_corr_sql('EstCO2_kg_per_m2', 5)}) "
    f"UNION ALL SELECT feature, 'only_a' FROM ({_top_corr_sql('BerRating', 5)} EXCEPT {_top_corr_sql('EstCO2_kg_per_m2', 5)}) "
    f"UNION ALL SELECT feature, 'only_b' FROM ({_top_corr_sql('EstCO2_kg_per_m2', 5)} EXCEPT {_top_corr_sql('BerRating', 5)})"))
def intersect_names(spark, sf):
    cl = common.clean(spark, sf)
    # |r| rounded to 9 decimals before ranking: perfectly correlated features
    # tie up to float noise, and the tie is then broken by name
    rank = lambda t: Q.target_correlations(cl, FEATS, t).withColumn("abs_r", F.round("abs_r", 9)) \
        .orderBy(F.desc_nulls_last("abs_r"), "feature").limit(5)
    a, b = rank("BerRating"), rank("EstCO2_kg_per_m2")
    return S.intersect_names(a, b)
