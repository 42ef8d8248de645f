"""Fixed values of the domain: bounds, factors, tariffs, weights and thresholds."""

from __future__ import annotations

# ---- fixed values: geography -------------------------------------------------
EARTH_RADIUS_M = 6_371_000.0
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
BOUNDS = {"lat_min": 5.9, "lat_max": 9.8, "lon_min": 79.6, "lon_max": 81.9}
URBAN_BOX = {"lat_min": 6.8, "lat_max": 7.0, "lon_min": 79.8, "lon_max": 80.0}

# ---- fixed values: calendar --------------------------------------------------
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"]
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAYS_IN_MONTH = {1: 31, 2: 28, 3: 31, 4: 30, 5: 31, 6: 30, 7: 31, 8: 31, 9: 30, 10: 31, 11: 30, 12: 31}
HOLIDAY_MONTHS = [1, 4, 5, 12]
PRE_HOLIDAY_MONTHS = [3, 11]
POST_HOLIDAY_MONTHS = [2, 6]
DRY_MONTHS = [2, 3, 4, 7, 8]
WET_MONTHS = [5, 6, 9, 10, 11]
INTERMEDIATE_MONTHS = [1, 12]
SERVING_WET_MONTHS = [5, 6, 7, 8, 9]
SERVING_INTERMEDIATE_MONTHS = [10, 11]

# ---- fixed values: consumption factors ---------------------------------------
FORECAST_SEASONAL = {1: 0.85, 2: 0.90, 3: 1.15, 4: 1.25, 5: 1.20, 6: 1.00,
                     7: 0.85, 8: 0.90, 9: 1.00, 10: 1.10, 11: 1.05, 12: 0.95}
EXPANSION_SEASONAL = {1: 0.90, 2: 0.95, 3: 1.15, 4: 1.25, 5: 1.20, 6: 1.00,
                      7: 0.95, 8: 0.90, 9: 1.00, 10: 1.10, 11: 1.05, 12: 0.95}
EXPANSION_SOLAR = {1: 1.10, 2: 1.15, 3: 1.20, 4: 1.15, 5: 1.00, 6: 0.60,
                   7: 0.65, 8: 0.70, 9: 0.95, 10: 1.05, 11: 1.00, 12: 1.10}
MIN_NET_KWH, MAX_NET_KWH = 10.0, 2000.0
MAX_IMPORT_KWH, MAX_EXPORT_KWH = 5000.0, 2000.0

# ---- fixed values: tariffs ---------------------------------------------------
TARIFFS = {
    "D1": {"blocks": [(0, 30, 8.0), (31, 60, 10.0), (61, 90, 16.0), (91, 120, 50.0),
                      (121, 180, 75.0), (181, 9999, 100.0)],
           "fixed_charge": 180.0, "fuel_adjustment": 0.18, "vat_rate": 0.18},
    "GP1": {"blocks": [(0, 100, 45.0), (101, 9999, 55.0)],
            "fixed_charge": 240.0, "fuel_adjustment": 0.18, "vat_rate": 0.18},
}
DEFAULT_TARIFF = "D1"
VALID_TARIFFS = ["D1", "GP1", "GP2"]
VALID_PHASES = ["SP", "TP"]
DASHBOARD_BLOCKS = [(30, 8.0), (30, 10.0), (30, 16.0), (30, 50.0), (60, 75.0), (9999, 100.0)]
EXPORT_TARIFF_UNDER_5, EXPORT_TARIFF_OVER_5 = 20.90, 19.61

# ---- fixed values: similarity ------------------------------------------------
SIMILARITY_WEIGHTS = {"geographic": 0.15, "consumption_pattern": 0.60, "technical": 0.15,
                      "seasonal_compatibility": 0.10}
SIMILARITY_RADIUS_M = 2000.0
MIN_SIMILARITY = 0.4
TOP_SIMILAR = 10
MAGNITUDE_LADDER = [(0.95, 1.05, 1.0), (0.9, 1.1, 0.8), (0.85, 1.15, 0.5), (0.8, 1.2, 0.2)]

# upper bound of the user's median kWh -> (smallest, largest) allowed adjustment
ADJUSTMENT_LADDER = [(50, 0.10, 1.20), (75, 0.12, 1.18), (100, 0.15, 1.15), (125, 0.18, 1.15),
                     (150, 0.22, 1.12), (175, 0.26, 1.12), (200, 0.30, 1.10), (250, 0.35, 1.10),
                     (300, 0.40, 1.08), (400, 0.50, 1.08), (None, 0.60, 1.05)]

# ---- fixed values: transformers ----------------------------------------------
TRANSFORMER_CAPACITY_KW = 100.0
HOURS_PER_MONTH = 720.0
SAFETY_MARGIN, CURTAILMENT_LIMIT = 0.80, 0.75
SUITABILITY_WEIGHTS = {"headroom": 0.40, "distance": 0.30, "stability": 0.30}
RULE_SHARE, MODEL_SHARE = 0.55, 0.45
CAPACITY_TIERS = [1.5, 3.0, 5.0, 7.5, 10.0, 15.0, 20.0]
RISK_TIERS = ["Underutilised — Low Risk", "Balanced Load — Medium Risk", "High Utilisation — High Risk"]

# ---- fixed values: solar physics ---------------------------------------------
PERFORMANCE_RATIO, TEMP_COEFFICIENT, TEMP_REFERENCE = 0.80, -0.005, 25.0
NET_PLUS_TARIFF, MAE_KWH_PER_KW = 27.06, 18.0
HUMIDITY_DEFAULT = 75.0
SENTINEL_LIMIT = -990.0
GHI_IMPUTE_MONTHS = [11, 12]
RESIDENTIAL_MAX_KW = 20.0
SOLAR_DROP_COLUMNS = ["TRANSFORMER_CODE", "TRANSFORMER_LAT", "TRANSFORMER_LON", "CUSTOMER_LAT",
                      "CUSTOMER_LON", "DISTANCE_FROM_TF_M", "DATA_QUALITY", "SOURCE", "CAL_TARIFF",
                      "PHASE", "YEAR", "HAS_SOLAR", "NET_CONSUMPTION_kWh", "IMPORT_kWh",
                      "Total_Generation_kWh", "Max_Temperature", "Min_Temperature", "Clear_Sky_GHI"]
SOLAR_MODEL_FEATURES = ["Month", "INV_CAPACITY", "Solar_Irradiance_GHI", "Temperature", "Humidity",
                        "Precipitation", "Wind_Speed", "Temp_Efficiency", "Temp_Range", "GHI_Adjusted",
                        "Cloud_Factor", "Month_Sin", "Month_Cos", "Days_In_Month",
                        "Expected_Generation", "Physics_Pred"]
KNN_FEATURES = ["Solar_Irradiance_GHI", "Temperature", "Cloud_Factor"]
STATIC_TEMPERATURE = {1: 26.5, 2: 27.0, 3: 28.0, 4: 28.5, 5: 28.5, 6: 28.0,
                      7: 27.5, 8: 27.5, 9: 27.5, 10: 27.0, 11: 26.5, 12: 26.0}
STATIC_HUMIDITY = {1: 75.0, 2: 70.0, 3: 70.0, 4: 75.0, 5: 80.0, 6: 80.0,
                   7: 80.0, 8: 80.0, 9: 80.0, 10: 80.0, 11: 80.0, 12: 80.0}
STATIC_RAINFALL = {1: 100.0, 2: 80.0, 3: 120.0, 4: 200.0, 5: 300.0, 6: 200.0,
                   7: 150.0, 8: 150.0, 9: 200.0, 10: 300.0, 11: 300.0, 12: 200.0}
# weather service parameter name -> column
WEATHER_PARAMETERS = {"ALLSKY_SFC_SW_DWN": "Solar_Irradiance_GHI", "T2M": "Temperature",
                      "T2M_MAX": "Max_Temperature", "T2M_MIN": "Min_Temperature", "RH2M": "Humidity",
                      "PRECTOTCORR": "Precipitation", "WS10M": "Wind_Speed",
                      "CLRSKY_SFC_SW_DWN": "Clear_Sky_GHI"}
CLIMATOLOGY_KEYS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]

# ---- fixed values: finance ---------------------------------------------------
DEFAULT_PRICES = {3: 750000, 5: 800000, 8: 1450000, 10: 1800000, 15: 2600000, 20: 2900000}
FALLBACK_PRICE_PER_KW = 200000.0
PRICE_SIZES = [3, 5, 8, 10, 15, 20]
PRICE_FLOOR, PRICE_CEILING = 300_000, 6_000_000
BASE_IMPORT_TARIFF, DISCOUNT_RATE, PROJECT_YEARS = 45.0, 0.10, 20
MAINTENANCE_SHARE, INVERTER_SHARE = 0.01, 0.25

# ---- fixed values: patterns of price pages -----------------------------------
PAGE_TAG = r"(?s)<[^>]*>"
PRICE_NODE = r'(?is)<p[^>]*class="price"[^>]*>(.*?)</p>'
PRICE_EVENT = r"(?i)\b\d+kW(?: system)?|starting from|Rs\.?\s*[\d,]+|LKR\s*[\d,]+\s*[-–]\s*[\d,]+|[\n\r\u0085\u2028\u2029]"

# ---- fixed values: monitoring ------------------------------------------------
DRIFT_WINDOW, DRIFT_THRESHOLD = 6, 2.0
ENSEMBLE_WEIGHTS = {"lstm": 0.5, "pattern": 0.5}
