"""Fixed values and rule parameters.

Everything in this module is data, not logic.  Values marked FIXED VALUES
must equal the original analysis for results to agree (band edges, grade
limits, emission factors, fuel sets, thresholds); change them only on purpose.
"""

from __future__ import annotations

import json
from pathlib import Path

_HERE = Path(__file__).parent

# ---------------------------------------------------------------------------
# FIXED VALUES — construction-age bands (right-closed intervals).
# Edges and labels in natural order; a year y falls in (edge[i], edge[i+1]].
# ---------------------------------------------------------------------------
AGE_EDGES = [0, 1900, 1930, 1950, 1967, 1978, 1983, 1994, 2000, 2005, 2011, 2016, 9999]
AGE_LABELS = ["Pre1900", "1900-1929", "1930-1949", "1950-1966", "1967-1977",
              "1978-1982", "1983-1993", "1994-1999", "2000-2004", "2005-2010",
              "2011-2015", "2016+"]

# ---------------------------------------------------------------------------
# FIXED VALUES — energy-rating grades, left-closed [lo, hi).
# ---------------------------------------------------------------------------
GRADE_BANDS = [
    (0, 25, "A1"), (25, 50, "A2"), (50, 75, "A3"),
    (75, 100, "B1"), (100, 125, "B2"), (125, 150, "B3"),
    (150, 175, "C1"), (175, 200, "C2"), (200, 225, "C3"),
    (225, 260, "D1"), (260, 300, "D2"),
    (300, 340, "E1"), (340, 380, "E2"),
    (380, 450, "F"),
    (450, 9999, "G"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — CO2 emission factor per main heating fuel (kg CO2 / kWh).
# Keys are cut at 30 characters exactly as they appear in the source data.
# ---------------------------------------------------------------------------
CO2_FACTORS = {
    "Mains Gas": 0.2040,
    "Natural Gas": 0.2040,
    "Heating Oil": 0.2630,
    "Oil": 0.2630,
    "Electricity": 0.2950,
    "Electricity - Off-peak Night-R": 0.2950,
    "Electricity - Standard Domesti": 0.2950,
    "Electricity - On-peak Night-Ra": 0.2950,
    "Solid Multi-Fuel": 0.3400,
    "House Coal": 0.3400,
    "Anthracite": 0.3400,
    "Manufactured Smokeless Fuel": 0.3420,
    "Manufactured Smokeless Fuel (MSF)": 0.3420,
    "Peat Briquettes": 0.3620,
    "Sod Peat": 0.3550,
    "Milled Peat": 0.3550,
    "Bulk LPG (propane or butane)": 0.2140,
    "Bottled LPG": 0.2140,
    "LPG": 0.2140,
    "Wood Pellets (bulk supply for": 0.0150,
    "Wood Pellets (in bags for seco": 0.0150,
    "Wood Pellets": 0.0150,
    "Wood Logs": 0.0120,
    "Wood Chips": 0.0120,
    "Biomass": 0.0150,
    "Biodiesel from renewable sourc": 0.0180,
    "Bioethanol from renewable sour": 0.0180,
}
DEFAULT_CO2_FACTOR = 0.2500

# FIXED VALUES — fuels that count towards fuel-poverty risk.
FUEL_POVERTY_FUELS = [
    "Heating Oil", "Oil",
    "Solid Multi-Fuel", "House Coal", "Anthracite",
    "Manufactured Smokeless Fuel", "Manufactured Smokeless Fuel (MSF)",
    "Sod Peat", "Milled Peat", "Peat Briquettes",
    "Bulk LPG (propane or butane)", "Bottled LPG", "LPG",
]
FUEL_POVERTY_RATING = 300.0

# FIXED VALUES — insulation / glazing / heat-pump flag thresholds.
ROOF_INSULATED_MAX_U = 0.16
WALL_INSULATED_MAX_U = 0.37
GLAZING_MAX_U = 2.0
HEAT_PUMP_MIN_EFFICIENCY = 100.0
HEAT_PUMP_TEXT = "heat pump"
YES_TOKENS = ["YES", "Y"]
HES_FALSE_TOKENS = ["no", "", "none", "0", "0.0"]

# FIXED VALUES — fabric heat-loss pairs (U-value column, area column).
FABRIC_PAIRS = [
    ("UValueWall", "WallArea"),
    ("UValueRoof", "RoofArea"),
    ("UValueFloor", "FloorArea"),
    ("UValueWindow", "WindowArea"),
    ("UvalueDoor", "DoorArea"),
]

# FIXED VALUES — valid ranges (inclusive) for the target and the build year.
RATING_RANGE = (0.0, 2000.0)
YEAR_RANGE = (1700, 2026)

# FIXED VALUES — constant fills applied by the clean step (newest rules).
CONSTANT_FILLS = {
    "SolarHotWaterHeating": "NO",
    "LowEnergyLightingPercent": 0.0,
    "HESSchemeUpgrade": "No",
    "FirstEnergyType_Description": "None",
}
MEDIAN_FILL_COLUMNS = ["GroundFloorAreasq_m"]
MODE_FILL_COLUMNS = ["MainSpaceHeatingFuel", "MainWaterHeatingFuel"]
MODE_DEFAULT = "Unknown"

# FIXED VALUES — placeholder tokens that mean "missing".
PLACEHOLDERS = {
    "StructureType": ["Please select"],
    "PredominantRoofType": ["Select Roof Type", ""],
}

# FIXED VALUES — rating bands used in the cleaning report.
RATING_REPORT_BANDS = [(None, 100.0, "<=100"), (100.0, 200.0, "101-200"),
                       (200.0, 300.0, "201-300"), (300.0, None, ">300")]

# Columns never used as model features (target, group key, policy labels).
NON_FEATURES = ["BerRating", "CountyName", "EstCO2_kg_per_m2", "Total_Annual_CO2_Tonnes",
                "wall_insulated", "roof_insulated", "heating_upgraded",
                "is_retrofitted", "fuel_poverty_risk"]


def scenarios_json() -> str:
    """Raw text of the retrofit-measure catalogue shipped with the package.
    Its keys, labels and override values are fixed values of the domain."""
    return (_HERE / "scenarios.json").read_text(encoding="utf-8")


def scenarios() -> dict:
    return json.loads(scenarios_json())
