"""The energy-certificate pipeline: clean -> features -> policy labels.

This is the only module that knows the certificate column names (together
with ``config``).  ``clean_pipeline`` is one lazy chain of narrow
projections plus two small fit jobs (one median, one mode), so the whole clean
step is one scan-filter-project stage per input partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlens import config
from hearthlens.functions import features as fx
from hearthlens.operators import clean as C

# FIXED VALUES — text columns stripped by the clean step.
STRING_COLUMNS = [
    "CountyName", "DwellingTypeDescr", "TypeofRating", "PurposeOfRating",
    "MultiDwellingMPRN", "ThermalMassCategory", "StructureType",
    "SuspendedWoodenFloor", "PredominantRoofType",
    "FirstWallType_Description", "FirstWallIsSemiExposed",
    "SecondWallType_Description", "SecondWallIsSemiExposed",
    "DraftLobby", "VentilationMethod", "PermeabilityTest",
    "CHBoilerThermostatControlled", "OBBoilerThermostatControlled",
    "OBPumpInsideDwelling", "WarmAirHeatingSystem", "UndergroundHeating",
    "StorageLosses", "ManuLossFactorAvail", "SolarHotWaterHeating",
    "ElecImmersionInSummer", "CombiBoiler", "KeepHotFacility",
    "InsulationType", "PrimaryCircuitLoss",
    "CylinderStat", "CombinedCylinder", "SWHPumpSolarPowered",
    "ChargingBasisHeatConsumed",
    "MainSpaceHeatingFuel", "MainWaterHeatingFuel",
    "FirstEnergyType_Description", "SecondEnergyType_Description",
    "HESSchemeUpgrade",
]

# FIXED VALUES — leaky model-output columns removed by the clean step.
DROP_LEAKY = ["DistributionLosses", "HSEffAdjFactor", "WHEffAdjFactor",
              "SHRenewableResources", "WHRenewableResources"]

RANGES = {"BerRating": config.RATING_RANGE, "Year_of_Construction": config.YEAR_RANGE}


def range_filter(df: DataFrame) -> DataFrame:
    return C.filter_range(df, RANGES)


def add_features(df: DataFrame) -> DataFrame:
    """Physical features and flags (all narrow column expressions)."""
    cols = set(df.columns)
    new = {}
    heat_pump = []
    if "HSMainSystemEfficiency" in cols:
        heat_pump.append(F.col("HSMainSystemEfficiency") > config.HEAT_PUMP_MIN_EFFICIENCY)
    if "MainSpaceHeatingFuel" in cols:
        heat_pump.append(fx.contains_ci("MainSpaceHeatingFuel", config.HEAT_PUMP_TEXT))
    new["IsHeatPump"] = fx.flag_any_of(*heat_pump) if heat_pump else F.lit(0).cast("tinyint")
    if "Year_of_Construction" in cols:
        new["AgeBand"] = fx.age_band("Year_of_Construction")
    if "SolarHotWaterHeating" in cols:
        new["HasSolarWaterHeating"] = fx.flag_yes("SolarHotWaterHeating")
    if "UValueRoof" in cols:
        new["HasRoofInsulation"] = fx.threshold_flag("UValueRoof", config.ROOF_INSULATED_MAX_U)
    if "UValueWall" in cols:
        new["HasWallInsulation"] = fx.threshold_flag("UValueWall", config.WALL_INSULATED_MAX_U)
    if "UValueWindow" in cols:
        new["HasDoubleGlazing"] = fx.threshold_flag("UValueWindow", config.GLAZING_MAX_U)
    if {"WindowArea", "WallArea"} <= cols:
        new["WindowToWallRatio"] = fx.safe_ratio("WindowArea", "WallArea")
    if all(u in cols and a in cols for u, a in config.FABRIC_PAIRS):
        new["FabricHeatLossProxy"] = fx.weighted_sum_pairs(config.FABRIC_PAIRS)
    df = df.withColumns(new)
    if {"FabricHeatLossProxy", "GroundFloorAreasq_m"} <= set(df.columns):
        df = df.withColumn("FabricHeatLossPerM2",
                           fx.ratio_or_numerator("FabricHeatLossProxy", "GroundFloorAreasq_m"))
    return df


def add_policy_labels(df: DataFrame, target: str = "BerRating") -> DataFrame:
    """CO2 estimates and retrofit / fuel-poverty labels."""
    cols = set(df.columns)
    fuel = "MainSpaceHeatingFuel" if "MainSpaceHeatingFuel" in cols else None
    co2 = (fx.co2_intensity(target, fuel) if fuel
           else F.col(target) * F.lit(config.DEFAULT_CO2_FACTOR))
    df = df.withColumn("EstCO2_kg_per_m2", co2)
    new = {}
    if "FloorArea" in cols:
        new["Total_Annual_CO2_Tonnes"] = fx.co2_total_tonnes(F.col("EstCO2_kg_per_m2"), "FloorArea")
    if "UValueWall" in cols:
        new["wall_insulated"] = fx.threshold_flag("UValueWall", config.WALL_INSULATED_MAX_U)
    if "UValueRoof" in cols:
        new["roof_insulated"] = fx.threshold_flag("UValueRoof", config.ROOF_INSULATED_MAX_U)
    hes = fx.hes_flag("HESSchemeUpgrade") if "HESSchemeUpgrade" in cols else F.lit(False)
    new["heating_upgraded"] = fx.to_byte(F.col("IsHeatPump").cast("boolean") | hes)
    df = df.withColumns(new)
    flags = [c for c in ("wall_insulated", "roof_insulated", "heating_upgraded", "HasSolarWaterHeating")
             if c in df.columns]
    poor = F.col(target) > config.FUEL_POVERTY_RATING
    fp = (poor & fx.in_set(fuel, config.FUEL_POVERTY_FUELS)) if fuel else poor
    return df.withColumns({"is_retrofitted": fx.any_flag(*flags),
                           "fuel_poverty_risk": fx.to_byte(fp)})


def clean_pipeline(df: DataFrame, approx: bool = False, narrow: bool = False) -> DataFrame:
    """Full clean (C18): strings -> range -> drop leaky -> fills -> features -> labels.

    Fill statistics (one median, the fuel modes) are fitted on the range-filtered
    table by one aggregate job; everything else is lazy.  ``narrow`` casts
    doubles to float at the very end (sink-side), never before the math.
    """
    df = C.trim_strings(df, [c for c in STRING_COLUMNS if c in df.columns])
    df = C.placeholder_to_null(df, config.PLACEHOLDERS)
    df = range_filter(df)
    df = df.drop(*[c for c in DROP_LEAKY if c in df.columns])
    df = C.fill_constant(df, config.CONSTANT_FILLS)
    stats = C.fit_impute_stats(
        df, numeric=[c for c in config.MEDIAN_FILL_COLUMNS if c in df.columns],
        text=[c for c in config.MODE_FILL_COLUMNS if c in df.columns],
        approx=approx, default_mode=config.MODE_DEFAULT)
    df = C.apply_impute_stats(df, stats)
    df = add_features(df)
    df = add_policy_labels(df)
    if narrow:
        df = C.narrow_types(df, exclude=["l_orderkey", "l_partkey", "l_suppkey"])
    return df


def clean_pipeline_with_stats(df: DataFrame, stats: C.ImputeStats) -> DataFrame:
    """Apply step only, with frozen statistics (used by the streaming clean)."""
    df = C.trim_strings(df, [c for c in STRING_COLUMNS if c in df.columns])
    df = C.placeholder_to_null(df, config.PLACEHOLDERS)
    df = range_filter(df)
    df = df.drop(*[c for c in DROP_LEAKY if c in df.columns])
    df = C.fill_constant(df, config.CONSTANT_FILLS)
    df = C.apply_impute_stats(df, stats)
    return add_policy_labels(add_features(df))


def fit_clean_stats(df: DataFrame, approx: bool = False) -> C.ImputeStats:
    df = C.trim_strings(df, [c for c in STRING_COLUMNS if c in df.columns])
    df = C.placeholder_to_null(df, config.PLACEHOLDERS)
    df = range_filter(df)
    df = C.fill_constant(df, config.CONSTANT_FILLS)
    return C.fit_impute_stats(
        df, numeric=[c for c in config.MEDIAN_FILL_COLUMNS if c in df.columns],
        text=[c for c in config.MODE_FILL_COLUMNS if c in df.columns],
        approx=approx, default_mode=config.MODE_DEFAULT)
