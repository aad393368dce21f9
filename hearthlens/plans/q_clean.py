"""Cleaning and imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlens import config
from hearthlens.functions import features as fx
from hearthlens.operators import clean as C
from hearthlens.operators import relational as R
from hearthlens.plans import common, dwelling
from hearthlens.plans.oracle import with_clean, with_proxy
from hearthlens.plans.registry import register
from hearthlens.sources.tables import DWELLING_KEY

K = ", ".join(DWELLING_KEY)
TEXT = ["CountyName", "DwellingTypeDescr", "StructureType", "MainSpaceHeatingFuel", "SolarHotWaterHeating",
        "HESSchemeUpgrade", "StorageLosses"]


@register("C01", "trim_strings", with_proxy(f"SELECT {K}, " + ", ".join(f"trim({c}) AS {c}" for c in TEXT) + " FROM dwellings"))
def trim_strings(spark, sf):
    return C.trim_strings(common.proxy(spark, sf), TEXT).select(*DWELLING_KEY, *TEXT)


@register("C02", "placeholder_to_null", with_proxy(
    f"SELECT {K}, CASE WHEN StructureType IN ('Please select') THEN NULL ELSE StructureType END AS StructureType FROM dwellings"))
def placeholder_to_null(spark, sf):
    return C.placeholder_to_null(common.proxy(spark, sf), config.PLACEHOLDERS).select(*DWELLING_KEY, "StructureType")


@register("C03", "coerce_numeric", with_proxy(f"SELECT {K}, TRY_CAST(DeclaredLossFactor AS DOUBLE) AS DeclaredLossFactor FROM dwellings"))
def coerce_numeric(spark, sf):
    return C.coerce_numeric(common.proxy(spark, sf), ["DeclaredLossFactor"]).select(*DWELLING_KEY, "DeclaredLossFactor")


NUM_PROXY = ["l_quantity", "l_linenumber", "Year_of_Construction", "BerRating", "UValueWall", "WallArea", "NoOfSidesSheltered"]


@register("C04", "harmonise_types", with_proxy(
    "SELECT l_orderkey, l_partkey, l_suppkey, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUM_PROXY) + " FROM dwellings"))
def harmonise_types(spark, sf):
    return C.harmonise_types(common.proxy(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", *NUM_PROXY), NUM_PROXY)


CLEAN_DOUBLES = ["BerRating", "UValueWall", "UValueRoof", "UValueFloor", "UValueWindow", "UvalueDoor", "WallArea",
                 "RoofArea", "FloorArea", "WindowArea", "DoorArea", "GroundFloorAreasq_m", "HSMainSystemEfficiency",
                 "HSSupplHeatFraction", "NoOfSidesSheltered", "WindowToWallRatio", "FabricHeatLossProxy",
                 "FabricHeatLossPerM2", "EstCO2_kg_per_m2", "Total_Annual_CO2_Tonnes"]


@register("C05", "narrow_types", with_clean(
    f"SELECT {K}, " + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in ["BerRating", "UValueWall", "FabricHeatLossProxy",
                                                                       "EstCO2_kg_per_m2"]) + " FROM clean"))
def narrow_types(spark, sf):
    d = common.clean(spark, sf).select(*DWELLING_KEY, "BerRating", "UValueWall", "FabricHeatLossProxy", "EstCO2_kg_per_m2")
    return C.narrow_types(d, exclude=DWELLING_KEY)


@register("C06", "fill_constant", with_proxy(
    f"SELECT {K}, coalesce(SolarHotWaterHeating, 'NO') AS SolarHotWaterHeating, coalesce(HESSchemeUpgrade, 'No') AS HESSchemeUpgrade,"
    " coalesce(StorageLosses, 'No_cylinder') AS StorageLosses, coalesce(NoOfSidesSheltered, 0e0) AS NoOfSidesSheltered FROM dwellings"))
def fill_constant(spark, sf):
    d = C.fill_constant(common.proxy(spark, sf), {"SolarHotWaterHeating": "NO", "HESSchemeUpgrade": "No",
                                                  "StorageLosses": "No_cylinder", "NoOfSidesSheltered": 0.0})
    return d.select(*DWELLING_KEY, "SolarHotWaterHeating", "HESSchemeUpgrade", "StorageLosses", "NoOfSidesSheltered")


@register("C07", "fill_zero_block", with_proxy(
    f"SELECT {K}, coalesce(HSMainSystemEfficiency, 0e0) AS HSMainSystemEfficiency,"
    " coalesce(HSSupplHeatFraction, 0e0) AS HSSupplHeatFraction FROM dwellings"))
def fill_zero_block(spark, sf):
    d = C.fill_zero_block(common.proxy(spark, sf), ["HSMainSystemEfficiency", "HSSupplHeatFraction"])
    return d.select(*DWELLING_KEY, "HSMainSystemEfficiency", "HSSupplHeatFraction")


@register("C08", "fill_median", with_proxy(
    f"SELECT {K}, coalesce(GroundFloorAreasq_m, (SELECT median(GroundFloorAreasq_m) FROM dwellings)) AS GroundFloorAreasq_m,"
    " coalesce(HSMainSystemEfficiency, (SELECT median(HSMainSystemEfficiency) FROM dwellings)) AS HSMainSystemEfficiency FROM dwellings"))
def fill_median(spark, sf):
    d = C.fill_median(common.proxy(spark, sf), ["GroundFloorAreasq_m", "HSMainSystemEfficiency"])
    return d.select(*DWELLING_KEY, "GroundFloorAreasq_m", "HSMainSystemEfficiency")


def _mode_sql(c, src="dwellings", where="TRUE"):
    return (f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL AND {where} GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


@register("C09", "fill_mode", with_proxy(
    f"SELECT {K}, coalesce(MainSpaceHeatingFuel, {_mode_sql('MainSpaceHeatingFuel')}) AS MainSpaceHeatingFuel,"
    f" coalesce(StructureType, {_mode_sql('StructureType')}) AS StructureType FROM dwellings"))
def fill_mode(spark, sf):
    d = C.fill_mode(common.proxy(spark, sf), ["MainSpaceHeatingFuel", "StructureType"])
    return d.select(*DWELLING_KEY, "MainSpaceHeatingFuel", "StructureType")


# Statistics fitted on the training split of the range-filtered table,
# applied to every row (the fitted values are one row: a bounded result).
TRAIN_SQL = ("(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + l_suppkey * 17 + l_quantity) % 100 < 70")
STAT_NUM = ["GroundFloorAreasq_m", "HSMainSystemEfficiency", "HSSupplHeatFraction", "NoOfSidesSheltered"]
STAT_TXT = ["StructureType", "SolarHotWaterHeating", "HESSchemeUpgrade", "StorageLosses"]


def _fit_stats(spark, sf):
    from hearthlens.operators import ml
    d = dwelling.range_filter(common.proxy(spark, sf))
    train = d.where(ml.split_label(DWELLING_KEY) == "train")
    return d, C.fit_impute_stats(train, numeric=STAT_NUM, text=STAT_TXT)


@register("C10", "fit_impute_stats", with_proxy(
    "SELECT column_name, kind, value FROM (" + " UNION ALL ".join(
        [f"SELECT '{c}' AS column_name, 'median' AS kind, CAST(median({c}) AS VARCHAR) AS value FROM rf WHERE {TRAIN_SQL}"
         for c in STAT_NUM] +
        [f"SELECT '{c}', 'mode', '\"' || {_mode_sql(c, 'rf', TRAIN_SQL)} || '\"'" for c in STAT_TXT]) + ")",
    "rf AS (SELECT * FROM dwellings WHERE BerRating BETWEEN 0e0 AND 2000e0 AND Year_of_Construction BETWEEN 1700 AND 2026)"))
def fit_impute_stats(spark, sf):
    _, stats = _fit_stats(spark, sf)
    out = stats.as_row_df(spark)
    # medians are rendered as plain numbers (json of a float), modes as json strings
    return out


@register("C10", "apply_impute_stats", with_proxy(
    f"SELECT {K}, " + ", ".join(
        [f"coalesce({c}, (SELECT median({c}) FROM rf WHERE {TRAIN_SQL})) AS {c}" for c in STAT_NUM] +
        [f"coalesce({c}, {_mode_sql(c, 'rf', TRAIN_SQL)}) AS {c}" for c in STAT_TXT]) + " FROM rf",
    "rf AS (SELECT * FROM dwellings WHERE BerRating BETWEEN 0e0 AND 2000e0 AND Year_of_Construction BETWEEN 1700 AND 2026)"))
def apply_impute_stats(spark, sf):
    d, stats = _fit_stats(spark, sf)
    return C.apply_impute_stats(d, stats).select(*DWELLING_KEY, *STAT_NUM, *STAT_TXT)


def _group_mode_sql():
    def gm(keys, name):
        k = ", ".join(keys)
        return (f"{name} AS (SELECT {k}, StructureType AS {name}_v FROM (SELECT {k}, StructureType, "
                f"row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, StructureType) AS rn "
                f"FROM base WHERE StructureType IS NOT NULL GROUP BY {k}, StructureType) WHERE rn = 1)")
    return [
        f"base AS (SELECT {K}, AgeBand, DwellingTypeDescr, CountyName, StructureType FROM clean)",
        gm(["AgeBand", "DwellingTypeDescr", "CountyName"], "g0"),
        gm(["DwellingTypeDescr", "CountyName"], "g1"),
        gm(["CountyName"], "g2"),
    ]


@register("C11", "fill_group_mode", with_clean(
    f"SELECT base.l_orderkey, base.l_linenumber, base.l_partkey, base.l_suppkey, base.l_quantity, "
    f"coalesce(StructureType, g0_v, g1_v, g2_v, {_mode_sql('StructureType', 'base')}) AS StructureType_filled FROM base "
    "LEFT JOIN g0 USING (AgeBand, DwellingTypeDescr, CountyName) LEFT JOIN g1 USING (DwellingTypeDescr, CountyName) "
    "LEFT JOIN g2 USING (CountyName)", *_group_mode_sql()))
def fill_group_mode(spark, sf):
    d = common.clean(spark, sf).select(*DWELLING_KEY, "AgeBand", "DwellingTypeDescr", "CountyName", "StructureType")
    out = C.fill_group_mode(d, "StructureType", ["AgeBand", "DwellingTypeDescr", "CountyName"],
                            fallbacks=[["DwellingTypeDescr", "CountyName"], ["CountyName"]], out="StructureType_filled")
    return out.select(*DWELLING_KEY, "StructureType_filled")


@register("C12", "missing_flag", with_proxy(f"SELECT {K}, CAST(StorageLosses IS NOT NULL AS TINYINT) AS has_hw_cylinder FROM dwellings"))
def missing_flag(spark, sf):
    return C.missing_flag(common.proxy(spark, sf), "StorageLosses", "has_hw_cylinder").select(*DWELLING_KEY, "has_hw_cylinder")


REG_CTES = [
    "rb AS (SELECT *, CAST(dense_rank() OVER (ORDER BY DwellingTypeDescr) - 1 AS DOUBLE) AS type_code, "
    "CAST(Year_of_Construction AS DOUBLE) AS yr FROM clean)",
    "rc AS (SELECT * FROM rb WHERE HSSupplHeatFraction IS NOT NULL)",
    "rm AS (SELECT avg(yr) AS m1, avg(type_code) AS m2, avg(HSSupplHeatFraction) AS my FROM rc)",
    "rs AS (SELECT sum((yr - m1) * (yr - m1)) AS s11, sum((yr - m1) * (type_code - m2)) AS s12, "
    "sum((type_code - m2) * (type_code - m2)) AS s22, sum((yr - m1) * (HSSupplHeatFraction - my)) AS s1y, "
    "sum((type_code - m2) * (HSSupplHeatFraction - my)) AS s2y, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my FROM rc, rm)",
    "rbeta AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, "
    "(s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM rs)",
]


@register("C13", "fill_by_regression", with_clean(
    f"SELECT {K}, coalesce(HSSupplHeatFraction, round(my - b1 * m1 - b2 * m2 + b1 * yr + b2 * type_code, 3)) AS HSSupplHeatFraction "
    "FROM rb, rbeta", *REG_CTES))
def fill_by_regression(spark, sf):
    """OLS of the supplementary-heat fraction on (year, encoded type) over
    complete rows; nulls filled with the prediction (rounded, 3 dp)."""
    d = _type_code(common.clean(spark, sf)).withColumn("yr", F.col("Year_of_Construction").cast("double"))
    out = C.fill_by_regression(d, "HSSupplHeatFraction", ["yr", "type_code"], decimals=3)
    return out.select(*DWELLING_KEY, "HSSupplHeatFraction")


def _type_code(df):
    """Adds ``type_code``: place of the dwelling type among the sorted types,
    null last.  The label list goes into the row expression: no join."""
    from pyspark.ml.feature import StringIndexer

    return StringIndexer(inputCol="DwellingTypeDescr", outputCol="type_code", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df).transform(df)


@register("C14", "fill_by_classification")
def fill_by_classification(spark, sf):
    """Multinomial logistic model fills the missing structure type from the
    year and the dwelling type (seeded fit: checked by properties, not SQL)."""
    d = _type_code(common.clean(spark, sf).select(*DWELLING_KEY, "StructureType", "DwellingTypeDescr", "Year_of_Construction"))
    out = C.fill_by_classification(d, "StructureType", ["Year_of_Construction", "type_code"],
                                   out="StructureType_filled", max_iter=500)
    return out.select(*DWELLING_KEY, "StructureType", "StructureType_filled")


@register("C15", "iqr_fence", with_clean(
    f"SELECT {K}, BerRating FROM clean, (SELECT quantile_cont(BerRating, 0.25) AS q1, quantile_cont(BerRating, 0.75) AS q3 "
    f"FROM clean WHERE {TRAIN_SQL}) WHERE q3 - q1 = 0 OR BerRating BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)"))
def iqr_fence(spark, sf):
    from hearthlens.operators import ml
    cl = common.clean(spark, sf)
    train = cl.where(ml.split_label(DWELLING_KEY) == "train")
    return C.iqr_fence(cl, "BerRating", 1.5, fit_on=train).select(*DWELLING_KEY, "BerRating")


@register("C16", "three_sigma_smooth", with_clean(
    f"SELECT {K}, round(CASE WHEN abs(UValueWindow - m) > 3e0 * s THEN m ELSE UValueWindow END, 6) AS UValueWindow, "
    "round(CASE WHEN abs(FabricHeatLossProxy - m2) > 3e0 * s2 THEN m2 ELSE FabricHeatLossProxy END, 6) AS FabricHeatLossProxy "
    "FROM clean, (SELECT avg(UValueWindow) AS m, stddev_samp(UValueWindow) AS s, avg(FabricHeatLossProxy) AS m2, "
    "stddev_samp(FabricHeatLossProxy) AS s2 FROM clean)"))
def three_sigma_smooth(spark, sf):
    d = C.three_sigma_smooth(common.clean(spark, sf), ["UValueWindow", "FabricHeatLossProxy"])
    return d.select(*DWELLING_KEY, F.round("UValueWindow", 6).alias("UValueWindow"),
                    F.round("FabricHeatLossProxy", 6).alias("FabricHeatLossProxy"))


FORMULA_SCORE = "50e0 + 1e-1 * FabricHeatLossProxy - 2e1 * IsHeatPump"


def formula_score(df):
    return F.lit(50.0) + F.lit(0.1) * F.col("FabricHeatLossProxy") - F.lit(20.0) * F.col("IsHeatPump")


@register("C17", "residual_outlier_filter", with_clean(
    f"SELECT {K} FROM (SELECT *, BerRating - ({FORMULA_SCORE}) AS r FROM clean), "
    f"(SELECT avg(BerRating - ({FORMULA_SCORE})) AS m, stddev_pop(BerRating - ({FORMULA_SCORE})) AS s FROM clean) "
    "WHERE abs((r - m) / s) < 3e0"))
def residual_outlier_filter(spark, sf):
    d = common.clean(spark, sf).withColumn("score", formula_score(None))
    return C.residual_outlier_filter(d, "BerRating", "score", 3.0).select(*DWELLING_KEY)


@register("C18", "clean_pipeline", with_clean(
    "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in CLEAN_DOUBLES) + ") FROM clean"))
def clean_pipeline(spark, sf):
    return dwelling.clean_pipeline(common.proxy(spark, sf), narrow=True)
