"""Scalar feature queries (E01-E23): row-level projections over the proxy / clean table."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import functions as F

from hearthlens import config
from hearthlens.functions import features as fx
from hearthlens.plans import common
from hearthlens.plans.oracle import age_band_sql, co2_factor_sql, grade_sql, with_clean, with_proxy
from hearthlens.plans.registry import register
from hearthlens.sources.tables import DWELLING_KEY

K = ", ".join(DWELLING_KEY)


def _key(df, *cols):
    return df.select(*DWELLING_KEY, *cols)


@register("E01", "safe_ratio", with_proxy(
    f"SELECT {K}, CASE WHEN WallArea > 0 THEN WindowArea / WallArea ELSE 0e0 END AS window_wall_ratio FROM dwellings"))
def safe_ratio(spark, sf):
    return _key(common.proxy(spark, sf), fx.safe_ratio("WindowArea", "WallArea").alias("window_wall_ratio"))


@register("E02", "weighted_sum_pairs", with_proxy(
    f"SELECT {K}, UValueWall * WallArea + UValueRoof * RoofArea + UValueFloor * FloorArea"
    " + UValueWindow * WindowArea + UvalueDoor * DoorArea AS fabric_heat_loss FROM dwellings"))
def weighted_sum_pairs(spark, sf):
    return _key(common.proxy(spark, sf), fx.weighted_sum_pairs().alias("fabric_heat_loss"))


@register("E03", "ratio_or_numerator", with_proxy(
    f"SELECT {K}, CASE WHEN GroundFloorAreasq_m > 0 THEN f / GroundFloorAreasq_m ELSE f END AS heat_loss_per_m2 "
    "FROM (SELECT *, UValueWall * WallArea + UValueRoof * RoofArea + UValueFloor * FloorArea"
    " + UValueWindow * WindowArea + UvalueDoor * DoorArea AS f FROM dwellings)"))
def ratio_or_numerator(spark, sf):
    d = common.proxy(spark, sf).withColumn("f", fx.weighted_sum_pairs())
    return _key(d, fx.ratio_or_numerator("f", "GroundFloorAreasq_m").alias("heat_loss_per_m2"))


@register("E04", "weighted_average_fallback", with_proxy(
    f"SELECT {K}, CASE WHEN WallArea + RoofArea > 0 THEN (UValueWall * WallArea + UValueRoof * RoofArea)"
    " / (WallArea + RoofArea) ELSE UValueWall END AS avg_opaque_u FROM dwellings"))
def weighted_average_fallback(spark, sf):
    e = fx.weighted_average_fallback(["UValueWall", "UValueRoof"], ["WallArea", "RoofArea"], "UValueWall")
    return _key(common.proxy(spark, sf), e.alias("avg_opaque_u"))


@register("E05", "row_sum", with_proxy(
    f"SELECT {K}, WallArea + RoofArea + FloorArea + WindowArea + DoorArea AS envelope_area FROM dwellings"))
def row_sum(spark, sf):
    e = fx.row_sum(["WallArea", "RoofArea", "FloorArea", "WindowArea", "DoorArea"])
    return _key(common.proxy(spark, sf), e.alias("envelope_area"))


@register("E06", "bin_right_closed", with_proxy(f"SELECT {K}, {age_band_sql()} AS AgeBand FROM dwellings"))
def bin_right_closed(spark, sf):
    return _key(common.proxy(spark, sf), fx.age_band().alias("AgeBand"))


@register("E07", "bin_left_closed", with_proxy(f"SELECT {K}, {grade_sql('BerRating')} AS grade FROM dwellings"))
def bin_left_closed(spark, sf):
    return _key(common.proxy(spark, sf), fx.rating_grade().alias("grade"))


@register("E08", "threshold_flag", with_proxy(
    f"SELECT {K}, CAST(coalesce(UValueRoof <= 0.16e0, false) AS TINYINT) AS HasRoofInsulation,"
    " CAST(coalesce(UValueWall <= 0.37e0, false) AS TINYINT) AS HasWallInsulation,"
    " CAST(coalesce(UValueWindow <= 2e0, false) AS TINYINT) AS HasDoubleGlazing FROM dwellings"))
def threshold_flag(spark, sf):
    return _key(common.proxy(spark, sf),
                fx.threshold_flag("UValueRoof", config.ROOF_INSULATED_MAX_U).alias("HasRoofInsulation"),
                fx.threshold_flag("UValueWall", config.WALL_INSULATED_MAX_U).alias("HasWallInsulation"),
                fx.threshold_flag("UValueWindow", config.GLAZING_MAX_U).alias("HasDoubleGlazing"))


@register("E09", "flag_any_of", with_proxy(
    f"SELECT {K}, CAST(coalesce(HSMainSystemEfficiency > 100e0, false) OR "
    "coalesce(contains(lower(MainSpaceHeatingFuel), 'heat pump'), false) AS TINYINT) AS IsHeatPump FROM dwellings"))
def flag_any_of(spark, sf):
    e = fx.flag_any_of(F.col("HSMainSystemEfficiency") > 100.0, fx.contains_ci("MainSpaceHeatingFuel", "heat pump"))
    return _key(common.proxy(spark, sf), e.alias("IsHeatPump"))


@register("E10", "flag_yes", with_proxy(
    f"SELECT {K}, CAST(coalesce(upper(SolarHotWaterHeating) IN ('YES', 'Y'), false) AS TINYINT) AS HasSolarWaterHeating,"
    " CAST(coalesce(upper(StorageLosses) IN ('YES', 'Y'), false) AS TINYINT) AS HasStorageLosses FROM dwellings"))
def flag_yes(spark, sf):
    return _key(common.proxy(spark, sf), fx.flag_yes("SolarHotWaterHeating").alias("HasSolarWaterHeating"),
                fx.flag_yes("StorageLosses").alias("HasStorageLosses"))


@register("E11", "map_with_default", with_proxy(f"SELECT {K}, {co2_factor_sql()} AS co2_factor FROM dwellings"))
def map_with_default(spark, sf):
    return _key(common.proxy(spark, sf), fx.co2_factor().alias("co2_factor"))


@register("E12", "co2_estimate", with_clean(
    f"SELECT {K}, EstCO2_kg_per_m2, Total_Annual_CO2_Tonnes FROM clean"))
def co2_estimate(spark, sf):
    return _key(common.clean(spark, sf), "EstCO2_kg_per_m2", "Total_Annual_CO2_Tonnes")


@register("E13", "composite_or_label", with_clean(f"SELECT {K}, heating_upgraded, is_retrofitted FROM clean"))
def composite_or_label(spark, sf):
    return _key(common.clean(spark, sf), "heating_upgraded", "is_retrofitted")


@register("E14", "composite_and_label", with_clean(f"SELECT {K}, fuel_poverty_risk FROM clean"))
def composite_and_label(spark, sf):
    return _key(common.clean(spark, sf), "fuel_poverty_risk")


@register("E15", "log1p_expm1", with_clean(
    f"SELECT {K}, round(ln(1e0 + BerRating), 6) AS log_target,"
    " round(greatest(exp(ln(1e0 + BerRating)) - 1e0, 0e0), 6) AS back_transformed FROM clean"))
def log1p_expm1(spark, sf):
    return _key(common.clean(spark, sf), F.round(fx.log1p_target("BerRating"), 6).alias("log_target"),
                F.round(fx.expm1_clipped(fx.log1p_target("BerRating")), 6).alias("back_transformed"))


@register("E16", "round_half_even", with_clean(
    "SELECT CountyName, CAST(round_even(CAST(CAST(avg(BerRating) AS VARCHAR) AS DECIMAL(38, 12)), 1) AS DOUBLE) AS mean_ber_even,"
    " CAST(round_even(CAST(CAST(avg(UValueWall) AS VARCHAR) AS DECIMAL(38, 12)), 2) AS DOUBLE) AS mean_uwall_even"
    " FROM clean GROUP BY CountyName"))
def round_half_even(spark, sf):
    return (common.clean(spark, sf).groupBy("CountyName")
            .agg(fx.round_half_even(F.avg("BerRating"), 1).alias("mean_ber_even"),
                 fx.round_half_even(F.avg("UValueWall"), 2).alias("mean_uwall_even")))


@register("E17", "ordinal_encode", with_clean(
    f"SELECT {K}, CAST(dense_rank() OVER (ORDER BY DwellingTypeDescr) - 1 AS INT) AS type_code FROM clean"))
def ordinal_encode(spark, sf):
    """Sorted categories -> 0..n-1 with Spark ML ``StringIndexer`` (fit = one
    distributed value count; the label list is bounded by the cardinality)."""
    cl = common.clean(spark, sf)
    idx = StringIndexer(inputCol="DwellingTypeDescr", outputCol="type_idx",
                        stringOrderType="alphabetAsc", handleInvalid="keep").fit(cl)
    n = len(idx.labels)
    out = idx.transform(cl)
    code = F.when(F.col("type_idx") >= n, F.lit(-1)).otherwise(F.col("type_idx")).cast("int")
    return _key(out, code.alias("type_code"))


@register("E18", "label_encode", with_clean(
    f"SELECT {K}, CAST(dense_rank() OVER (ORDER BY coalesce(StructureType, 'nan')) - 1 AS INT) AS structure_code FROM clean"))
def label_encode(spark, sf):
    """Text -> sorted index with nulls encoded as the string 'nan'.

    The sorted label list of ``StringIndexer`` (one value count) goes into the
    row expression: no join, so a label with most of the rows is no hot key."""
    cl = common.clean(spark, sf).withColumn("__v", F.coalesce(F.col("StructureType"), F.lit("nan")))
    idx = StringIndexer(inputCol="__v", outputCol="code", stringOrderType="alphabetAsc").fit(cl)
    return _key(idx.transform(cl), F.col("code").cast("int").alias("structure_code"))


#: part types of the benchmark tables in sorted order (a fixed value list)
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
ONE_HOT_SQL = with_clean(f"SELECT {K}, " + ", ".join(
    f"CAST(DwellingTypeDescr = '{t}' AS TINYINT) AS \"type_{t}\"" for t in TYPES[1:]) + " FROM clean")


@register("E19", "one_hot", ONE_HOT_SQL)
def one_hot(spark, sf):
    """Indicator columns with the first level dropped (Spark drops the last:
    encode with ``dropLast=False`` and remove index 0)."""
    cl = common.clean(spark, sf)
    idx = StringIndexer(inputCol="DwellingTypeDescr", outputCol="t_idx", stringOrderType="alphabetAsc").fit(cl)
    enc = OneHotEncoder(inputCols=["t_idx"], outputCols=["t_vec"], dropLast=False).fit(idx.transform(cl))
    out = enc.transform(idx.transform(cl))
    from pyspark.ml.functions import vector_to_array
    v = vector_to_array("t_vec")
    cols = [v[i].cast("tinyint").alias(f"type_{lab}") for i, lab in enumerate(idx.labels) if i > 0]
    return _key(out, *cols)


@register("E20", "standard_scale", with_clean(
    f"SELECT {K}, round((BerRating - avg(BerRating) OVER ()) / stddev_pop(BerRating) OVER (), 6) AS ber_z FROM clean"))
def standard_scale(spark, sf):
    """z-scores with ddof = 0: one aggregate (mean, population std) then a
    narrow projection with literals."""
    cl = common.clean(spark, sf)
    s = cl.agg(F.avg("BerRating").alias("m"), F.stddev_pop("BerRating").alias("s")).first()
    return _key(cl, F.round((F.col("BerRating") - s["m"]) / F.lit(s["s"]), 6).alias("ber_z"))


@register("E22", "format_text", with_clean(
    "SELECT CountyName, printf('%.1f', round(avg(BerRating), 1)) AS mean_ber_text,"
    " printf('%.1f%%', round(avg(CAST(is_retrofitted AS DOUBLE)) * 100e0, 1)) AS retrofit_text,"
    " printf('%d', count(*)) AS homes_text FROM clean GROUP BY CountyName"))
def format_text(spark, sf):
    g = common.clean(spark, sf).groupBy("CountyName").agg(
        F.round(F.avg("BerRating"), 1).alias("m"),
        F.round(F.avg(F.col("is_retrofitted").cast("double")) * 100.0, 1).alias("r"),
        F.count(F.lit(1)).alias("n"))
    return g.select("CountyName", F.format_string("%.1f", "m").alias("mean_ber_text"),
                    F.format_string("%.1f%%", "r").alias("retrofit_text"),
                    F.format_string("%d", "n").alias("homes_text"))


@register("E23", "string_ops", with_proxy(
    f"SELECT {K}, trim(MainSpaceHeatingFuel) AS fuel_trim, upper(trim(MainSpaceHeatingFuel)) AS fuel_upper,"
    " lower(trim(MainSpaceHeatingFuel)) AS fuel_lower, coalesce(contains(lower(MainSpaceHeatingFuel), 'oil'), false) AS has_oil,"
    " regexp_replace(trim(DwellingTypeDescr), ' ', '_', 'g') AS type_token FROM dwellings"))
def string_ops(spark, sf):
    d = common.proxy(spark, sf)
    return _key(d, F.trim("MainSpaceHeatingFuel").alias("fuel_trim"),
                F.upper(F.trim("MainSpaceHeatingFuel")).alias("fuel_upper"),
                F.lower(F.trim("MainSpaceHeatingFuel")).alias("fuel_lower"),
                fx.contains_ci("MainSpaceHeatingFuel", "oil").alias("has_oil"),
                F.regexp_replace(F.trim("DwellingTypeDescr"), " ", "_").alias("type_token"))
