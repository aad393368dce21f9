"""SQL building blocks for the independent DuckDB oracle.

These strings are *not* used by the Spark side: the Spark queries are built
with the DataFrame operators of the library.  The oracle re-states the same
semantics in plain SQL over the pre-registered benchmark views, so the two
implementations check each other.  Doubles are written as ``2e0`` so both
engines type them as DOUBLE.
"""

from __future__ import annotations

from hearthlens import config

PROXY_SQL = """
SELECT
  l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS l_quantity,
  n_name AS CountyName,
  concat(p_type, '   ') AS DwellingTypeDescr,
  CAST(1850 + (l_partkey * 7 + l_orderkey) % 175 AS INT) AS Year_of_Construction,
  CASE WHEN l_orderkey % 997 = 1 THEN -472.99e0
       WHEN l_orderkey % 991 = 1 THEN 32134.94e0
       ELSE l_extendedprice / 2e2 END AS BerRating,
  l_discount * 2e1 AS UValueWall,
  l_tax * 1e1 AS UValueRoof,
  (l_discount + l_tax) * 5e0 AS UValueFloor,
  l_quantity / 1e1 AS UValueWindow,
  3e0 AS UvalueDoor,
  CASE WHEN l_partkey % 101 = 0 THEN 0e0 ELSE p_size * 3e0 END AS WallArea,
  p_size * 1.5e0 AS RoofArea,
  l_quantity * 2e0 AS FloorArea,
  p_size * 0.5e0 AS WindowArea,
  1.85e0 AS DoorArea,
  CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_quantity * 2e0 END AS GroundFloorAreasq_m,
  CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE 60e0 + l_quantity * 1.1e0 END AS HSMainSystemEfficiency,
  CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE l_tax END AS HSSupplHeatFraction,
  CASE WHEN l_orderkey % 59 = 0 THEN NULL WHEN l_orderkey % 17 = 0 THEN 'Please select'
       ELSE c_mktsegment END AS StructureType,
  CASE WHEN l_orderkey % 59 = 0 THEN NULL ELSE l_linenumber * 1e0 END AS NoOfSidesSheltered,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Heating Oil   ' WHEN '2-HIGH' THEN 'Mains Gas'
       WHEN '3-MEDIUM' THEN 'Electricity' WHEN '4-NOT SPECIFIED' THEN 'Solid Multi-Fuel' END AS MainSpaceHeatingFuel,
  CASE l_returnflag WHEN 'A' THEN 'YES' WHEN 'R' THEN 'NO' END AS SolarHotWaterHeating,
  CASE WHEN l_linestatus = 'F' THEN 'No' WHEN l_orderkey % 5 = 0 THEN 'Yes' END AS HESSchemeUpgrade,
  CASE WHEN l_partkey % 7 = 0 THEN 'No' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS DeclaredLossFactor,
  CASE WHEN l_suppkey % 2 = 0 THEN 'YES' END AS StorageLosses
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN part ON l_partkey = p_partkey
"""


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(sql_str(v) for v in values)


def age_band_sql(c: str = "Year_of_Construction") -> str:
    parts = [f"WHEN {c} > {lo} AND {c} <= {hi} THEN {sql_str(lab)}"
             for lo, hi, lab in zip(config.AGE_EDGES[:-1], config.AGE_EDGES[1:], config.AGE_LABELS)]
    return "CASE " + " ".join(parts) + " END"


def grade_sql(c: str) -> str:
    b = config.GRADE_BANDS
    parts = [f"WHEN {c} IS NULL THEN NULL", f"WHEN {c} < {b[0][0]}e0 THEN {sql_str(b[0][2])}"]
    parts += [f"WHEN {c} >= {lo}e0 AND {c} < {hi}e0 THEN {sql_str(lab)}" for lo, hi, lab in b]
    return "CASE " + " ".join(parts) + f" ELSE {sql_str(b[-1][2])} END"


def co2_factor_sql(c: str = "MainSpaceHeatingFuel") -> str:
    parts = [f"WHEN {sql_str(k)} THEN {v!r}e0" if "e" not in repr(v) else f"WHEN {sql_str(k)} THEN {v!r}"
             for k, v in config.CO2_FACTORS.items()]
    return f"CASE trim({c}) " + " ".join(parts) + f" ELSE {config.DEFAULT_CO2_FACTOR!r}e0 END"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS TINYINT)"


CLEAN_CTES = f"""
dwellings AS ({PROXY_SQL}),
cl_trim AS (
  SELECT * REPLACE (
    trim(CountyName) AS CountyName,
    trim(DwellingTypeDescr) AS DwellingTypeDescr,
    CASE WHEN trim(StructureType) = 'Please select' THEN NULL ELSE trim(StructureType) END AS StructureType,
    trim(StorageLosses) AS StorageLosses,
    coalesce(trim(SolarHotWaterHeating), 'NO') AS SolarHotWaterHeating,
    trim(MainSpaceHeatingFuel) AS MainSpaceHeatingFuel,
    coalesce(trim(HESSchemeUpgrade), 'No') AS HESSchemeUpgrade)
  FROM dwellings
  WHERE BerRating BETWEEN 0e0 AND 2000e0 AND Year_of_Construction BETWEEN 1700 AND 2026
),
cl_med AS (SELECT median(GroundFloorAreasq_m) AS gfa_med FROM cl_trim),
cl_mode AS (
  SELECT MainSpaceHeatingFuel AS fuel_mode FROM cl_trim WHERE MainSpaceHeatingFuel IS NOT NULL
  GROUP BY MainSpaceHeatingFuel ORDER BY count(*) DESC, MainSpaceHeatingFuel LIMIT 1
),
cl_fill AS (
  SELECT cl_trim.* REPLACE (
    coalesce(GroundFloorAreasq_m, gfa_med) AS GroundFloorAreasq_m,
    coalesce(MainSpaceHeatingFuel, fuel_mode) AS MainSpaceHeatingFuel)
  FROM cl_trim, cl_med, cl_mode
),
cl_feat AS (
  SELECT *,
    CAST(coalesce(HSMainSystemEfficiency > 100e0, false)
         OR coalesce(contains(lower(MainSpaceHeatingFuel), 'heat pump'), false) AS TINYINT) AS IsHeatPump,
    {age_band_sql()} AS AgeBand,
    {flag("upper(SolarHotWaterHeating) IN ('YES', 'Y')")} AS HasSolarWaterHeating,
    {flag("UValueRoof <= 0.16e0")} AS HasRoofInsulation,
    {flag("UValueWall <= 0.37e0")} AS HasWallInsulation,
    {flag("UValueWindow <= 2e0")} AS HasDoubleGlazing,
    CASE WHEN WallArea > 0 THEN WindowArea / WallArea ELSE 0e0 END AS WindowToWallRatio,
    UValueWall * WallArea + UValueRoof * RoofArea + UValueFloor * FloorArea
      + UValueWindow * WindowArea + UvalueDoor * DoorArea AS FabricHeatLossProxy
  FROM cl_fill
),
cl_feat2 AS (
  SELECT *,
    CASE WHEN GroundFloorAreasq_m > 0 THEN FabricHeatLossProxy / GroundFloorAreasq_m
         ELSE FabricHeatLossProxy END AS FabricHeatLossPerM2,
    BerRating * {co2_factor_sql()} AS EstCO2_kg_per_m2
  FROM cl_feat
),
cl_lab AS (
  SELECT *,
    CASE WHEN FloorArea IS NULL THEN NULL
         ELSE EstCO2_kg_per_m2 * greatest(FloorArea, 0e0) / 1000e0 END AS Total_Annual_CO2_Tonnes,
    {flag("UValueWall <= 0.37e0")} AS wall_insulated,
    {flag("UValueRoof <= 0.16e0")} AS roof_insulated,
    CAST(CAST(IsHeatPump AS BOOLEAN)
         OR coalesce(NOT (lower(trim(HESSchemeUpgrade)) IN ({sql_list(config.HES_FALSE_TOKENS)})), false)
         AS TINYINT) AS heating_upgraded
  FROM cl_feat2
),
clean AS (
  SELECT *,
    CAST(wall_insulated = 1 OR roof_insulated = 1 OR heating_upgraded = 1 OR HasSolarWaterHeating = 1
         AS TINYINT) AS is_retrofitted,
    {flag(f"BerRating > 300e0 AND MainSpaceHeatingFuel IN ({sql_list(config.FUEL_POVERTY_FUELS)})")}
      AS fuel_poverty_risk
  FROM cl_lab
)
"""

PROFILE_CTE = """
profile AS (
  SELECT CountyName,
    count(BerRating) AS total_homes,
    round(avg(BerRating), 1) AS mean_ber,
    round(median(BerRating), 1) AS median_ber,
    round(avg(CASE WHEN BerRating <= 100e0 THEN 1e0 ELSE 0e0 END) * 100e0, 1) AS pct_AB,
    round(avg(CASE WHEN BerRating > 300e0 THEN 1e0 ELSE 0e0 END) * 100e0, 1) AS pct_EFG,
    round(avg(EstCO2_kg_per_m2), 2) AS mean_co2_kg_m2,
    round(sum(Total_Annual_CO2_Tonnes) / 1000e0, 1) AS total_co2_kt,
    round(avg(CAST(is_retrofitted AS DOUBLE)) * 100e0, 2) AS retrofit_rate,
    round(avg(CAST(fuel_poverty_risk AS DOUBLE)) * 100e0, 2) AS fuel_poverty_rate,
    round(avg(CAST(wall_insulated AS DOUBLE)) * 100e0, 2) AS wall_insulation_rate,
    round(avg(CAST(roof_insulated AS DOUBLE)) * 100e0, 2) AS roof_insulation_rate,
    round(avg(CAST(heating_upgraded AS DOUBLE)) * 100e0, 2) AS heating_upgrade_rate
  FROM clean GROUP BY CountyName
)
"""


def with_proxy(body: str, *extra_ctes: str) -> str:
    ctes = [f"dwellings AS ({PROXY_SQL})", *extra_ctes]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def with_clean(body: str, *extra_ctes: str) -> str:
    ctes = [CLEAN_CTES.strip(), *[c.strip() for c in extra_ctes]]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def with_profile(body: str, *extra_ctes: str) -> str:
    return with_clean(body, PROFILE_CTE, *extra_ctes)
