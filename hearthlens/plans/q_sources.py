"""Source / sink queries.

File-based operators need files: each query first writes data Spark derives
from the benchmark tables (the dwelling proxy or its clean form) to a fresh
folder under the shared checkpoint directory, then reads it back with the
operator under test, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlens import config
from hearthlens.operators import policy
from hearthlens.operators import scenario as SC
from hearthlens.plans import common, dwelling
from hearthlens.plans.oracle import PROXY_SQL, with_clean, with_profile, with_proxy
from hearthlens.plans.q_clean import CLEAN_DOUBLES
from hearthlens.plans.registry import register
from hearthlens.sources import files as FS
from hearthlens.sources.tables import DWELLING_KEY

K = ", ".join(DWELLING_KEY)


def _proxy_tsv(spark, sf):
    d = common.proxy(spark, sf)
    path = FS.sink_delimited(d, FS.scratch_path(spark, "tsv"))
    return d.schema, path


@register("S01", "scan_delimited", with_proxy("SELECT * FROM dwellings"))
def scan_delimited(spark, sf):
    schema, path = _proxy_tsv(spark, sf)
    return FS.scan_delimited(spark, path, schema)


def _proxy_csv(spark, sf):
    d = common.proxy(spark, sf)
    path = FS.sink_csv(d, FS.scratch_path(spark, "csv"))
    return d.schema, path


@register("S02", "scan_csv_columns", with_proxy(f"SELECT {K}, BerRating, Year_of_Construction, CountyName FROM dwellings"))
def scan_csv_columns(spark, sf):
    schema, path = _proxy_csv(spark, sf)
    return FS.scan_csv_columns(spark, path, schema, DWELLING_KEY + ["BerRating", "Year_of_Construction", "CountyName"])


@register("S03", "scan_csv_except", with_proxy(
    "SELECT * EXCLUDE (DeclaredLossFactor, StorageLosses, HSSupplHeatFraction) FROM dwellings"))
def scan_csv_except(spark, sf):
    schema, path = _proxy_csv(spark, sf)
    return FS.scan_csv_except(spark, path, schema, ["DeclaredLossFactor", "StorageLosses", "HSSupplHeatFraction"])


@register("S04", "scan_head", with_proxy(f"SELECT * FROM dwellings ORDER BY {K} LIMIT 100"))
def scan_head(spark, sf):
    # a head-of-table preview: the limit is the feature
    return common.proxy(spark, sf).orderBy(*DWELLING_KEY).limit(100)


@register("S05", "scan_random_lines", with_proxy(f"SELECT * FROM dwellings ORDER BY md5(concat_ws('|', {K}, 42)), {K} LIMIT 500"))
def scan_random_lines(spark, sf):
    # a random sample of lines: the limit is the feature
    return FS.scan_random_lines(common.proxy(spark, sf), 500, DWELLING_KEY, seed=42)


@register("S06", "scan_parquet", "SELECT * FROM customer")
def scan_parquet(spark, sf):
    return common.table(spark, sf, "customer")


@register("S07", "scan_parquet_columns", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_discount >= 0.05e0")
def scan_parquet_columns(spark, sf):
    # projection and filter reach the Parquet scan (ReadSchema / PushedFilters)
    return common.table(spark, sf, "lineitem").where(F.col("l_discount") >= 0.05).select(
        "l_orderkey", "l_linenumber", "l_extendedprice")


@register("S08", "scan_row_groups", with_clean(
    "SELECT * FROM clean"))
def scan_row_groups(spark, sf):
    """Chunk-at-a-time processing is Spark's partitioning: write the proxy,
    read it back in its input splits and clean every split with the same
    (frozen) statistics; the cleaned rows are the result."""
    d = common.proxy(spark, sf)
    path = FS.sink_parquet(d, FS.scratch_path(spark, "rowgroups"))
    stats = dwelling.fit_clean_stats(spark.read.parquet(path))
    return dwelling.clean_pipeline_with_stats(spark.read.parquet(path), stats)


def _scenario_json_path(spark):
    path = FS.scratch_path(spark, "scenarios") + ".json"
    spark.createDataFrame([(config.scenarios_json(),)], "value string").coalesce(1).write.text(path)
    return path


@register("S09", "scan_scenarios", with_clean(
    "SELECT scenario, count(*) AS rows, n_overrides FROM clean CROSS JOIN (VALUES " +
    ", ".join(f"('{k}', {len(v['overrides'])})" for k, v in config.scenarios().items()) +
    ") s(scenario, n_overrides) GROUP BY scenario, n_overrides"))
def scan_scenarios(spark, sf):
    """Read the scenario catalogue (JSON) with Spark, then expand the clean
    table by it; rows per scenario and override count."""
    cat = SC.read_scenarios(spark, _scenario_json_path(spark))
    measures = {r["key"]: {"name": r["name"], "label": r["label"], "description": r["description"],
                           "overrides": dict(r["overrides"]), "recompute_derived": r["recompute_derived"]}
                for r in cat.collect()}  # catalogue-sized (config), not data-sized
    x = SC.expand(common.clean(spark, sf).select(*DWELLING_KEY), measures)
    return x.groupBy(F.col("scenario.key").alias("scenario")).agg(
        F.count(F.lit(1)).alias("rows"), F.first(F.size("scenario.overrides")).alias("n_overrides"))


@register("S10", "sink_parquet", with_clean(
    "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in CLEAN_DOUBLES) + ") FROM clean"))
def sink_parquet(spark, sf):
    cl = dwelling.clean_pipeline(common.proxy(spark, sf), narrow=True)
    path = FS.sink_parquet(cl, FS.scratch_path(spark, "clean"))
    return spark.read.parquet(path)


@register("S11", "sink_parquet_incremental", with_proxy("SELECT * FROM dwellings"))
def sink_parquet_incremental(spark, sf):
    from hearthlens.streaming.stream import stream_append
    d = common.proxy(spark, sf)
    src = FS.sink_parquet(d, FS.scratch_path(spark, "arriving"))
    return stream_append(spark, src, d.schema, FS.scratch_path(spark, "appended"), FS.scratch_path(spark, "ckpt"))


PROFILE_SCHEMA = T.StructType([T.StructField("CountyName", T.StringType()), T.StructField("total_homes", T.LongType())] +
                              [T.StructField(c, T.DoubleType()) for c in
                               ["mean_ber", "median_ber", "pct_AB", "pct_EFG", "mean_co2_kg_m2", "total_co2_kt",
                                "retrofit_rate", "fuel_poverty_rate", "wall_insulation_rate", "roof_insulation_rate",
                                "heating_upgrade_rate"]])


@register("S12", "sink_csv", with_profile("SELECT * FROM profile"))
def sink_csv(spark, sf):
    prof = common.profile(spark, sf, sort=True)
    path = FS.sink_csv(prof, FS.scratch_path(spark, "profile-csv"), single_file=True)
    return spark.read.option("header", True).schema(PROFILE_SCHEMA).csv(path)


@register("S13", "convert_delimited", with_proxy("SELECT * FROM dwellings"))
def convert_delimited(spark, sf):
    schema, path = _proxy_tsv(spark, sf)
    return FS.convert_delimited(spark, path, FS.scratch_path(spark, "converted"), schema)


@register("S14", "split_complete_incomplete", with_proxy(
    "SELECT (GroundFloorAreasq_m IS NOT NULL AND HSMainSystemEfficiency IS NOT NULL AND StructureType IS NOT NULL "
    "AND MainSpaceHeatingFuel IS NOT NULL AND SolarHotWaterHeating IS NOT NULL) AS is_complete, count(*) AS rows "
    "FROM dwellings GROUP BY 1"))
def split_complete_incomplete(spark, sf):
    return FS.split_complete_incomplete(
        common.proxy(spark, sf), FS.scratch_path(spark, "split"),
        ["GroundFloorAreasq_m", "HSMainSystemEfficiency", "StructureType", "MainSpaceHeatingFuel", "SolarHotWaterHeating"])


@register("S15", "report_rows", with_profile(
    "SELECT '| ' || CountyName || ' | ' || format('{:,}', total_homes) || ' | ' || printf('%.1f', round(mean_ber, 1)) || ' | ' || "
    "printf('%.1f', round(pct_AB, 1)) || '% | ' || printf('%.1f', round(pct_EFG, 1)) || '% | ' || printf('%.1f', round(mean_co2_kg_m2, 1)) || ' | ' || "
    "printf('%.1f', round(retrofit_rate, 1)) || '% | ' || printf('%.1f', round(fuel_poverty_rate, 1)) || '% | ' || "
    "printf('%.1f', round(wall_insulation_rate, 1)) || '% | ' || printf('%.1f', round(roof_insulation_rate, 1)) || '% |' AS line, "
    "CountyName FROM profile"))
def report_rows(spark, sf):
    fmt = [("CountyName", "text"), ("total_homes", "int"), ("mean_ber", "1f"), ("pct_AB", "1f%"), ("pct_EFG", "1f%"),
           ("mean_co2_kg_m2", "1f"), ("retrofit_rate", "1f%"), ("fuel_poverty_rate", "1f%"),
           ("wall_insulation_rate", "1f%"), ("roof_insulation_rate", "1f%")]
    return FS.markdown_rows(common.profile(spark, sf), fmt)
