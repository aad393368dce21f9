"""Data-quality queries (Q01-Q19, G16) over the proxy / clean tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlens import config
from hearthlens.operators import clean as C
from hearthlens.operators import quality as Q
from hearthlens.plans import common
from hearthlens.plans.oracle import sql_list, sql_str, with_clean, with_proxy
from hearthlens.plans.registry import register
from hearthlens.sources.tables import DWELLING_KEY

K = ", ".join(DWELLING_KEY)

PROXY_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "CountyName",
                 "DwellingTypeDescr", "Year_of_Construction", "BerRating", "UValueWall", "UValueRoof",
                 "UValueFloor", "UValueWindow", "UvalueDoor", "WallArea", "RoofArea", "FloorArea", "WindowArea",
                 "DoorArea", "GroundFloorAreasq_m", "HSMainSystemEfficiency", "HSSupplHeatFraction", "StructureType",
                 "NoOfSidesSheltered", "MainSpaceHeatingFuel", "SolarHotWaterHeating", "HESSchemeUpgrade",
                 "DeclaredLossFactor", "StorageLosses"]
TEXT = ["CountyName", "DwellingTypeDescr", "StructureType", "MainSpaceHeatingFuel", "SolarHotWaterHeating",
        "HESSchemeUpgrade", "DeclaredLossFactor", "StorageLosses"]
NUMERIC = ["Year_of_Construction", "BerRating", "UValueWall", "UValueRoof", "UValueFloor", "UValueWindow",
           "UvalueDoor", "WallArea", "RoofArea", "FloorArea", "WindowArea", "DoorArea", "GroundFloorAreasq_m",
           "HSMainSystemEfficiency", "HSSupplHeatFraction", "NoOfSidesSheltered"]


def per_column_sql(cols, select_fmt, source="dwellings"):
    """UNION ALL of one aggregate row per column; {c} is the column."""
    return " UNION ALL ".join(f"SELECT {sql_str(c)} AS column_name, {select_fmt.format(c=c)} FROM {source}" for c in cols)


@register("Q01", "null_profile", with_proxy(per_column_sql(
    PROXY_COLUMNS, "count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows, "
    "count(*) FILTER (WHERE {c} IS NULL) / count(*) AS null_share")))
def null_profile(spark, sf):
    return Q.null_profile(common.proxy(spark, sf), PROXY_COLUMNS)


@register("Q02", "sparse_columns", with_proxy(
    "SELECT * FROM (" + per_column_sql(PROXY_COLUMNS, "count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows, "
                                       "count(*) FILTER (WHERE {c} IS NULL) / count(*) AS null_share") + ") WHERE null_share > 0.2e0"))
def sparse_columns(spark, sf):
    return Q.sparse_columns(common.proxy(spark, sf), 0.2, PROXY_COLUMNS)


_TOK = sql_list(dict.fromkeys(Q.SUSPICIOUS_TOKENS))


@register("Q03", "placeholder_columns", with_proxy(
    "SELECT *, missing_like > rows * 0.5e0 AS flagged FROM (SELECT *, nulls + tokens AS missing_like FROM (" +
    per_column_sql(TEXT, "count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
                   f"count(*) FILTER (WHERE coalesce({{c}}, 'nan') IN ({_TOK})) AS tokens, count(*) AS rows") + "))"))
def placeholder_columns(spark, sf):
    return Q.placeholder_profile(common.proxy(spark, sf), TEXT)


@register("Q04", "zero_columns", with_proxy(
    "SELECT *, zero_share > 0.5e0 AS flagged FROM (SELECT *, zeros_or_nulls / rows AS zero_share FROM (" +
    per_column_sql(NUMERIC, "count(*) FILTER (WHERE {c} IS NULL OR {c} = 0) AS zeros_or_nulls, count(*) AS rows") + "))"))
def zero_columns(spark, sf):
    return Q.zero_profile(common.proxy(spark, sf), NUMERIC)


@register("Q05", "cardinality_class", with_proxy(
    "SELECT *, CASE WHEN n_distinct > rows * 0.5e0 THEN 'id_like' WHEN n_distinct > 15 THEN 'high' ELSE 'normal' END "
    "AS cardinality_class FROM (" + per_column_sql(TEXT, "count(DISTINCT {c}) AS n_distinct, count(*) AS rows") + ")"))
def cardinality_class(spark, sf):
    return Q.cardinality_class(common.proxy(spark, sf), TEXT)


@register("Q06", "cardinality_ci", with_proxy(
    "SELECT *, distinct_ci > 15 AS many_values FROM (" +
    per_column_sql(TEXT, "count(DISTINCT coalesce(lower({c}), 'nan')) AS distinct_ci") + ")"))
def cardinality_ci(spark, sf):
    return Q.cardinality_ci(common.proxy(spark, sf), TEXT)


_YN = sql_list(Q.YES_NO_VALUES)


@register("Q07", "binary_text_columns", with_proxy(
    "SELECT *, outside = 0 AND non_null > 0 AS is_binary FROM (" +
    per_column_sql(TEXT, f"count(*) FILTER (WHERE {{c}} IS NOT NULL AND NOT lower({{c}}) IN ({_YN})) AS outside, "
                   "count({c}) AS non_null") + ")"))
def binary_text_columns(spark, sf):
    return Q.binary_text_columns(common.proxy(spark, sf), TEXT)


def _blocks_sql():
    """Blocks = columns sharing a null count; all-null rows per block from the
    per-row list of null columns (generic: no block is named in advance)."""
    nulls = per_column_sql(PROXY_COLUMNS, "count(*) FILTER (WHERE {c} IS NULL) AS nulls")
    null_list = ", ".join(f"CASE WHEN {c} IS NULL THEN {sql_str(c)} END" for c in PROXY_COLUMNS)
    return [
        f"nb_nulls AS ({nulls})",
        "nb_blocks AS (SELECT nulls AS null_count, string_agg(column_name, ',' ORDER BY column_name) AS columns, "
        "CAST(count(*) AS INT) AS n_columns, list(column_name) AS cols FROM nb_nulls WHERE nulls > 0 "
        "GROUP BY nulls HAVING count(*) > 1)",
        f"nb_rows AS (SELECT list_filter([{null_list}], lambda x: x IS NOT NULL) AS ns FROM dwellings)",
        "nb_hits AS (SELECT null_count, any_value(columns) AS columns, any_value(n_columns) AS n_columns, "
        "count(*) FILTER (WHERE list_has_all(ns, cols)) AS rows_all_null FROM nb_blocks, nb_rows GROUP BY null_count)",
    ]


@register("Q08", "null_block_overlap", with_proxy(
    "SELECT CAST(null_count AS BIGINT) AS null_count, columns, n_columns, CAST(rows_all_null AS BIGINT) AS rows_all_null, "
    "CASE WHEN rows_all_null = null_count THEN 'identical rows' ELSE 'partial overlap' END AS verdict FROM nb_hits",
    *_blocks_sql()))
def null_block_overlap(spark, sf):
    return Q.null_block_overlap(common.proxy(spark, sf), PROXY_COLUMNS)


@register("Q09", "near_zero_variance_text", with_proxy(
    "SELECT column_name, max(n) AS top_n, CAST(sum(n) AS BIGINT) AS non_null, count(*) AS n_unique, max(n) / sum(n) AS top_share, "
    "max(n) / sum(n) >= 0.95e0 AS nzv_flag FROM (SELECT column_name, value, count(*) AS n FROM (" +
    " UNION ALL ".join(f"SELECT {sql_str(c)} AS column_name, {c} AS value FROM dwellings" for c in TEXT) +
    ") WHERE value IS NOT NULL GROUP BY column_name, value) GROUP BY column_name"))
def near_zero_variance_text(spark, sf):
    r = Q.near_zero_variance_text(common.proxy(spark, sf), TEXT)
    return r.withColumn("non_null", F.col("non_null").cast("bigint")) \
            .select("column_name", "top_n", "non_null", "n_unique", "top_share", "nzv_flag")


@register("Q10", "near_zero_variance_num", with_clean(
    "SELECT column_name, round(std, 6) AS std, std < 1e-6 AS nzv_flag FROM (" +
    per_column_sql(NUMERIC + ["IsHeatPump", "UvalueDoor"], "stddev_samp(CAST({c} AS DOUBLE)) AS std", "clean") + ")"))
def near_zero_variance_num(spark, sf):
    r = Q.near_zero_variance_num(common.clean(spark, sf), NUMERIC + ["IsHeatPump", "UvalueDoor"])
    return r.select("column_name", F.round("std", 6).alias("std"), "nzv_flag")


@register("Q11", "describe", with_clean(per_column_sql(
    NUMERIC, "count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    "CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
    "round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max", "clean")))
def describe(spark, sf):
    r = Q.describe(common.clean(spark, sf), NUMERIC)
    return r.select("column_name", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
                    *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "max")


TARGET_FEATS = ["UValueWall", "UValueRoof", "UValueFloor", "UValueWindow", "WallArea", "RoofArea", "FloorArea",
                "WindowArea", "GroundFloorAreasq_m", "HSMainSystemEfficiency", "FabricHeatLossProxy",
                "WindowToWallRatio", "EstCO2_kg_per_m2", "Total_Annual_CO2_Tonnes"]


@register("Q13", "target_correlation_alert", with_clean(
    "SELECT feature, round(r, 6) AS r, round(abs(r), 6) AS abs_r FROM (" +
    " UNION ALL ".join(f"SELECT {sql_str(c)} AS feature, corr(CAST({c} AS DOUBLE), BerRating) AS r FROM clean"
                       for c in TARGET_FEATS) + ") WHERE abs(r) > 0.8e0"))
def target_correlation_alert(spark, sf):
    r = Q.target_correlation_alert(common.clean(spark, sf), TARGET_FEATS, "BerRating", 0.8)
    return r.select("feature", F.round("r", 6).alias("r"), F.round("abs_r", 6).alias("abs_r"))


@register("Q14", "band_shares", with_clean(
    "SELECT round(avg(CASE WHEN BerRating <= 100e0 THEN 1e0 ELSE 0e0 END) * 100e0, 6) AS pct_le_100,"
    " round(avg(CASE WHEN BerRating > 100e0 AND BerRating <= 200e0 THEN 1e0 ELSE 0e0 END) * 100e0, 6) AS pct_le_200,"
    " round(avg(CASE WHEN BerRating > 200e0 AND BerRating <= 300e0 THEN 1e0 ELSE 0e0 END) * 100e0, 6) AS pct_le_300,"
    " round(avg(CASE WHEN BerRating > 300e0 THEN 1e0 ELSE 0e0 END) * 100e0, 6) AS pct_gt_300 FROM clean"))
def band_shares(spark, sf):
    r = Q.band_shares(common.clean(spark, sf), "BerRating")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@register("Q15", "reject_counts", with_proxy(
    "SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN BerRating IS NULL THEN 'BerRating_null' "
    "WHEN NOT (BerRating BETWEEN 0e0 AND 2000e0) THEN 'BerRating_range' "
    "WHEN Year_of_Construction IS NULL THEN 'Year_of_Construction_null' "
    "WHEN NOT (Year_of_Construction BETWEEN 1700 AND 2026) THEN 'Year_of_Construction_range' ELSE 'kept' END AS reason "
    "FROM dwellings) GROUP BY reason"))
def reject_counts(spark, sf):
    return C.reject_counts(common.proxy(spark, sf), {"BerRating": config.RATING_RANGE,
                                                     "Year_of_Construction": config.YEAR_RANGE})


@register("Q16", "value_counts", with_clean(
    "SELECT MainSpaceHeatingFuel, count(*) AS n, count(*) / (SELECT count(*) FROM clean) AS share FROM clean "
    "GROUP BY MainSpaceHeatingFuel ORDER BY n DESC, MainSpaceHeatingFuel NULLS FIRST LIMIT 3"))
def value_counts(spark, sf):
    return Q.value_counts(common.clean(spark, sf), "MainSpaceHeatingFuel", k=3)


def _each(expr: str, value: str) -> str:
    """One row per column of ``clean``: ``expr`` of the column (DuckDB)."""
    return f"(UNPIVOT (SELECT {expr} AS '\\1' FROM clean) ON COLUMNS(*) INTO NAME column_name VALUE {value})"


@register("Q17", "validation_summary", with_clean(
    "SELECT column_name, n AS rows, n - filled AS nulls, (n - filled) / n AS null_share, CASE t WHEN 'VARCHAR' THEN 'string' "
    "WHEN 'INTEGER' THEN 'int' ELSE lower(t) END AS data_type, CAST(count(*) OVER () AS INT) AS n_columns FROM "
    + _each("count(COLUMNS('(.*)'))", "filled") + " JOIN " + _each("typeof(min(COLUMNS('(.*)')))", "t")
    + " USING (column_name), (SELECT count(*) AS n FROM clean)"))
def validation_summary(spark, sf):
    return Q.validation_summary(common.clean(spark, sf))


@register("Q18", "sample_export", with_clean(
    f"SELECT {K}, CountyName, DwellingTypeDescr, StructureType FROM clean ORDER BY {K} LIMIT 1000"))
def sample_export(spark, sf):
    # the limit is the feature: a fixed-size export of the first rows by key
    return (common.clean(spark, sf).select(*DWELLING_KEY, "CountyName", "DwellingTypeDescr", "StructureType")
            .orderBy(*DWELLING_KEY).limit(1000))


@register("Q19", "feature_summary", with_clean(
    "SELECT 'WindowToWallRatio' AS feature, 'mean' AS stat, NULL AS value, round(avg(WindowToWallRatio), 6) AS number FROM clean "
    "UNION ALL SELECT 'FabricHeatLossProxy', 'mean', NULL, round(avg(FabricHeatLossProxy), 6) FROM clean "
    "UNION ALL SELECT 'AgeBand', 'count', AgeBand, CAST(count(*) AS DOUBLE) FROM clean GROUP BY AgeBand "
    "UNION ALL SELECT 'IsHeatPump', 'count', CAST(IsHeatPump AS VARCHAR), CAST(count(*) AS DOUBLE) FROM clean GROUP BY IsHeatPump "
    "UNION ALL SELECT 'HasRoofInsulation', 'count', CAST(HasRoofInsulation AS VARCHAR), CAST(count(*) AS DOUBLE) FROM clean GROUP BY HasRoofInsulation"))
def feature_summary(spark, sf):
    cl = common.clean(spark, sf)
    means = cl.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("WindowToWallRatio", "FabricHeatLossProxy")])
    out = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit("mean").alias("stat"),
                                                    F.lit(None).cast("string").alias("value"), F.col(c).alias("number"))
                                           for c in ("WindowToWallRatio", "FabricHeatLossProxy")])).alias("s")).select("s.*")
    for c in ("AgeBand", "IsHeatPump", "HasRoofInsulation"):
        vc = cl.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias("number"))
        out = out.unionByName(vc.select(F.lit(c).alias("feature"), F.lit("count").alias("stat"),
                                        F.col(c).cast("string").alias("value"), "number"))
    return out


@register("G16", "all_null_rows", with_proxy(
    "SELECT count(*) FILTER (WHERE HSMainSystemEfficiency IS NULL AND HSSupplHeatFraction IS NULL) AS systems_block_null,"
    " count(*) FILTER (WHERE StructureType IS NULL AND NoOfSidesSheltered IS NULL) AS envelope_block_null FROM dwellings"))
def all_null_rows(spark, sf):
    return common.proxy(spark, sf).agg(
        Q.all_null_rows(None, ["HSMainSystemEfficiency", "HSSupplHeatFraction"]).alias("systems_block_null"),
        Q.all_null_rows(None, ["StructureType", "NoOfSidesSheltered"]).alias("envelope_block_null"))
