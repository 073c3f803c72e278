"""Schemas, domain constants and small dimension tables.

The values below are FIXED VALUES that must equal the application being
re-implemented for results to agree (labels, thresholds, weights, texts).
They are kept together here, in their natural order, and every operator
reads them from this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — risk classes, horizons, actions
# ---------------------------------------------------------------------------
RISK_LABELS = {0: "LOW", 1: "MEDIUM", 2: "HIGH", 3: "CRITICAL"}
INSPECTION_DAYS = {0: 90, 1: 30, 2: 14, 3: 7}
RECOMMENDED_ACTIONS = {
    0: "No immediate action required. Continue regular maintenance schedule.",
    1: "Monitor closely. Schedule inspection within 30 days.",
    2: "Schedule preventive maintenance within 14 days. Inspect identified risk areas.",
    3: "URGENT: Schedule immediate inspection within 7 days. High failure probability detected.",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — failure reasons tracked as running counts, and their columns
# ---------------------------------------------------------------------------
TRACKED_FAILURES = {
    "Bearing Failure": "bearing_failure_count",
    "Winding Failure": "winding_failure_count",
    "Rotor Failure": "rotor_failure_count",
    "Insulation Failure": "insulation_failure_count",
}
FIRST_REPAIR_GAP_DAYS = 1095  # 3 * 365, gap assigned to a motor's first repair

# ---------------------------------------------------------------------------
# FIXED VALUES — risk score: scale of each component and its weight
# ---------------------------------------------------------------------------
AGE_SCALE_YEARS = 30
REPAIR_SCALE = 8
RECENCY_SCALE_DAYS = 1095
KW_SCALE = 500
FAILURE_SCALE = 6
RISK_WEIGHTS = {"age": 0.25, "repairs": 0.25, "recency": 0.15, "kw": 0.15, "failures": 0.20}
RISK_THRESHOLDS = (0.25, 0.45, 0.65)  # < t0 -> LOW, < t1 -> MEDIUM, < t2 -> HIGH, else CRITICAL
DEFAULT_AS_OF_YEAR = 2026

# ---------------------------------------------------------------------------
# FIXED VALUES — categorical encoders: source column -> encoded column
# ---------------------------------------------------------------------------
CATEGORICAL_COLUMNS = {
    "duty_cycle": "duty_cycle_encoded",
    "make": "make_encoded",
    "equipment_type_text": "equipment_type_encoded",
    "application_use": "application_use_encoded",
}
NULL_CATEGORY = "nan"  # text a missing category is encoded as
UNSEEN_CODE = -1

# ---------------------------------------------------------------------------
# FIXED VALUES — the 18 model features, in order
# ---------------------------------------------------------------------------
FEATURE_COLUMNS = [
    "motor_age_years",
    "kw",
    "rpm",
    "voltage",
    "current",
    "duty_cycle_encoded",
    "make_encoded",
    "equipment_type_encoded",
    "application_use_encoded",
    "repair_count",
    "days_since_last_repair",
    "previous_refurb_count",
    "bearing_failure_count",
    "winding_failure_count",
    "rotor_failure_count",
    "insulation_failure_count",
    "dept_failure_rate",
    "make_failure_rate",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — model health score and component probabilities
# ---------------------------------------------------------------------------
HEALTH_WEIGHT_HIGH = 0.3
HEALTH_WEIGHT_CRITICAL = 0.7
HEALTH_MIN, HEALTH_MAX = 5, 99
# component -> (weight of p_medium, p_high, p_critical), jitter range (low, high)
COMPONENTS = [
    ("Bearing Failure", (0.0, 0.4, 0.6), (0.8, 1.2)),
    ("Rotor Failure", (0.3, 0.5, 0.0), (0.3, 0.6)),
    ("Winding Failure", (0.2, 0.0, 0.4), (0.2, 0.5)),
    ("Insulation Failure", (0.0, 0.2, 0.3), (0.1, 0.4)),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — component advisory texts: (component, level) -> text,
# level 2 when percent > 50, level 1 when percent > 15, else level 0
# ---------------------------------------------------------------------------
ADVISORY_HIGH_PCT = 50
ADVISORY_MODERATE_PCT = 15
ADVISORIES = [
    ("Bearing Failure", 2, "High bearing failure risk: Seizure or clearance damage expected. Check bearing noise and greasing immediately."),
    ("Bearing Failure", 1, "Moderate bearing wear: Monitor temperature rise and vibration levels during continuous load."),
    ("Bearing Failure", 0, "Low bearing wear: Parameters are within nominal operating limits."),
    ("Rotor Failure", 2, "High rotor risk: Suspected broken rotor bars or eccentricity. Perform dynamic balancing check."),
    ("Rotor Failure", 1, "Moderate rotor wear: Minor air gap variance. Keep under watch for abnormal hum."),
    ("Rotor Failure", 0, "Rotor nominal: No significant electrical or mechanical balance offset."),
    ("Winding Failure", 2, "Critical winding risk: High phase imbalance or short-circuit suspected. Run insulation tests."),
    ("Winding Failure", 1, "Moderate winding stress: Possible localized overheating. Schedule regular winding check."),
    ("Winding Failure", 0, "Winding nominal: Phase resistances and insulation parameters are balanced."),
    ("Insulation Failure", 2, "Severe insulation degradation: Moisture ingress or age-induced breakdown. Run megger test before operation."),
    ("Insulation Failure", 1, "Moderate insulation drop: Moisture contamination likely. Baking or cleaning recommended."),
    ("Insulation Failure", 0, "Insulation nominal: Resistance values are well within standard limits."),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — inspection checklist codes and their effect
# ---------------------------------------------------------------------------
CHECKLIST_BEARING = ["R2", "G6"]
CHECKLIST_WINDING = ["S1", "S3"]
CHECKLIST_ROTOR = ["R3", "R1"]
CHECKLIST_INSULATION = ["S2"]
CHECKLIST_GENERAL = ["G4", "G5", "R5", "S5"]  # +1 repair, +1 refurb, gap capped
CHECKLIST_GAP_CAP_DAYS = 14

# ---------------------------------------------------------------------------
# FIXED VALUES — repair-shop statuses and dashboard bands
# ---------------------------------------------------------------------------
STATUS_RECEIVED = "RECEIVED"
STATUS_WORK_UP = ["UNDER_INSPECTION", "UNDER_REPAIR", "TESTING"]
STATUS_AT_SHOP = ["RECEIVED", "UNDER_INSPECTION", "UNDER_REPAIR", "TESTING"]
STATUS_DISPATCHED = "DISPATCHED"
STATUS_CLOSED = "CLOSED"
STATUS_DONE = ["CLOSED", "DISPATCHED"]
BEARING_SERVICE_PATTERN = "bearing"  # case-insensitive
SPARES_SERVICE_PATTERN = "rewinding|insulation"  # case-insensitive
REWINDING_PATTERN = "rewinding"
OVERHAUL_PATTERN = "overhaul|overhauling"
POWER_BANDS = [  # (order, name, lower bound exclusive, upper bound inclusive)
    (0, "> 100 KW", 100.0, None),
    (1, "25.1 - 100 KW", 25.0, 100.0),
    (2, "<= 25 KW", None, 25.0),
]
REWINDING_BANDS = [("0_7", None, 7), ("8_15", 7, 15), ("15_30", 15, 30), ("30_plus", 30, None)]
OVERHAUL_BANDS = [("0_3", None, 3), ("4_7", 3, 7), ("7_15", 7, 15), ("15_plus", 15, None)]

# ---------------------------------------------------------------------------
# Requisition schema (the explicit schema used for CSV scans; no inference)
# ---------------------------------------------------------------------------
REQUISITION_SCHEMA = T.StructType([
    T.StructField("requisition_id", T.LongType()),
    T.StructField("main_equipment_name", T.StringType()),
    T.StructField("equipment_serial_no", T.StringType()),
    T.StructField("motor_manufacturing_year", T.IntegerType()),
    T.StructField("application_use", T.StringType()),
    T.StructField("installed_location", T.StringType()),
    T.StructField("installed_qty", T.IntegerType()),
    T.StructField("make", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("frame", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("power_rating", T.DoubleType()),
    T.StructField("kw", T.DoubleType()),
    T.StructField("kva", T.DoubleType()),
    T.StructField("rpm", T.IntegerType()),
    T.StructField("duty_cycle", T.StringType()),
    T.StructField("voltage", T.IntegerType()),
    T.StructField("current", T.DoubleType()),
    T.StructField("received_date", T.StringType()),
    T.StructField("received_time", T.StringType()),
    T.StructField("defects_observed", T.StringType()),
    T.StructField("repairs_required", T.StringType()),
    T.StructField("reason_of_failure_id", T.IntegerType()),
    T.StructField("reason_of_failure_text", T.StringType()),
    T.StructField("warranty_status", T.StringType()),
    T.StructField("previous_refurbishment_job_no", T.StringType()),
    T.StructField("spares_details", T.StringType()),
    T.StructField("service_type_id", T.IntegerType()),
    T.StructField("service_type_text", T.StringType()),
    T.StructField("equipment_type_id", T.IntegerType()),
    T.StructField("equipment_type_text", T.StringType()),
    T.StructField("bearing_id", T.IntegerType()),
    T.StructField("bearing_text", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("updated_by", T.StringType()),
])

CHECKLIST_REQUEST_SCHEMA = T.StructType([
    T.StructField("serial_no", T.StringType()),
    T.StructField("checklist", T.ArrayType(T.StringType())),
])


# ---------------------------------------------------------------------------
# Small dimension tables built from the constants above (bounded by
# construction, so they are safe to broadcast).
# ---------------------------------------------------------------------------
def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small constant table built inside the JVM (no Python serialisation)."""
    from pyspark.sql import functions as F
    fields = T._parse_datatype_string(ddl).fields
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def risk_label_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, v, INSPECTION_DAYS[k], RECOMMENDED_ACTIONS[k]) for k, v in sorted(RISK_LABELS.items())]
    return literal_table(spark, rows, "risk_class int, risk_label string, inspection_days int, recommended_action string")


def advisory_dim(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ADVISORIES, "component string, level int, advisory string")


def power_band_dim(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(o, n) for o, n, _, _ in POWER_BANDS], "band_order int, category string")
