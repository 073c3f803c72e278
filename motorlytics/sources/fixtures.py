"""Requisition data derived from the driver tables.

A motor is a customer and a repair requisition is an order:
``orders ⋈ customer ⋈ nation``. Every attribute is a deterministic function of
the order and customer keys, so the same rows can be rebuilt in any SQL engine
(see ``motorlytics.oracle``). The join is left to the planner: the nation side
is a fixed 25-row TPC-H dimension that Spark broadcasts by its size estimate,
and the orders/customer join becomes a broadcast or a sort-merge join at run
time (AQE), with skewed customers split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlytics.sources.tables import read_table

# ---------------------------------------------------------------------------
# FIXED VALUES — attribute lists the fixture picks from by key modulus
# ---------------------------------------------------------------------------
EQUIPMENT_TYPES = ["AC Motor", "DC Motor", "Pump Motor", "Blower Motor", "Crane Motor", "Compressor Motor"]
RPMS = [750, 1000, 1500, 3000]
DUTY_CYCLES = [
    "Continuous (S1)",
    "Short Time (S2)",
    "Intermittent (S3)",
    "Continuous with Intermittent Load (S6)",
    "Periodic (S5)",
]
FAILURE_REASONS = [
    "Bearing Failure",
    "Winding Failure",
    "Rotor Failure",
    "Insulation Failure",
    "Overheating",
    "Vibration Damage",
]
SERVICE_TYPES = [
    "Rewinding",
    "Bearing Replacement",
    "General Overhaul",
    "Alignment Correction",
    "Insulation Repair",
    "Shaft Repair",
    "General Overhaul",
]
# order status -> (status for even order key, status for odd order key)
STATUS_BY_ORDER_STATUS = {"F": ("CLOSED", "DISPATCHED"), "O": ("RECEIVED", "UNDER_INSPECTION"),
                          "P": ("UNDER_REPAIR", "TESTING")}
CHECKLIST_CODES = ["G1", "G2", "G3", "G4", "G5", "G6", "R1", "R2", "R3", "R4", "R5",
                   "S1", "S2", "S3", "S4", "S5", "Z9"]


def pick(values: list, key: Column) -> Column:
    """values[key % len(values)] as a column expression (JVM-side)."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (key % len(values) + 1).cast("int"))


def serial_of(custkey: Column) -> Column:
    return F.concat(F.lit("EQ"), F.lpad(custkey.cast("string"), 7, "0"))


def custkey_of(serial: Column) -> Column:
    return F.substring(serial, 3, 64).cast("long")


def requisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requisition fact table (one row per order)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    ck, ok = F.col("o_custkey"), F.col("o_orderkey")
    kw = F.lit(0.75) + (ck % 200) * F.lit(2.5)
    volt_key = ck % 200
    voltage = F.when(volt_key < 3, F.lit(415)).when(volt_key < 53, F.lit(3300)).otherwise(F.lit(6600))
    even = (ok % 2) == 0
    status = F.lit(None).cast("string")
    for code, (on_even, on_odd) in STATUS_BY_ORDER_STATUS.items():
        status = F.when(F.col("o_orderstatus") == code, F.when(even, on_even).otherwise(on_odd)).otherwise(status)
    job_key = ok % 5
    job = (F.when(job_key < 2, F.lit(""))
           .when(job_key == 2, F.lit(None).cast("string"))
           .otherwise(F.concat(F.lit("JOB-"), (F.lit(10000) + ok % 90000).cast("string"))))
    received = F.col("o_orderdate").cast("date")
    etype = pick(EQUIPMENT_TYPES, ck)
    return j.select(
        ok.alias("requisition_id"),
        serial_of(ck).alias("equipment_serial_no"),
        (F.lit(1995) + ck % 29).cast("int").alias("motor_manufacturing_year"),
        F.col("n_name").alias("installed_location"),
        F.col("c_mktsegment").alias("make"),
        etype.alias("equipment_type_text"),
        etype.alias("main_equipment_name"),
        kw.alias("kw"),
        pick(RPMS, ck).alias("rpm"),
        voltage.alias("voltage"),
        (kw * F.lit(1000.0) / (F.lit(1.7320508) * voltage * F.lit(0.87))).alias("current"),
        pick(DUTY_CYCLES, ck).alias("duty_cycle"),
        F.concat(F.lit("Use "), (ck % 9).cast("string")).alias("application_use"),
        F.concat(F.lit("M"), (F.lit(100) + ck % 900).cast("string")).alias("model"),
        F.concat(F.lit("D"), (F.lit(80) + ck % 20).cast("string")).alias("frame"),
        status.alias("status"),
        pick(FAILURE_REASONS, ok).alias("reason_of_failure_text"),
        pick(SERVICE_TYPES, ok).alias("service_type_text"),
        job.alias("previous_refurbishment_job_no"),
        received.alias("received_date"),
        F.date_add(received, (ok % 45).cast("int")).cast("timestamp").alias("updated_at"),
    )


def inspection_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form checklist requests: one (request, serial, code) row per order."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return o.select(
        F.col("o_orderkey").alias("item_id"),
        serial_of(F.col("o_custkey")).alias("serial_no"),
        pick(CHECKLIST_CODES, F.col("o_orderkey")).alias("code"),
    )


def checklist_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request-shaped checklists ``(serial_no, checklist array)``.

    The array form is the request API's shape. It is built per request here,
    one request per order, so no group is collected into one array.
    """
    items = inspection_items(spark, sf_dir)
    return items.select("item_id", "serial_no", F.array("code").alias("checklist"))


def checklist_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests ``(request_id, serial_no, checklist)``, one per order: no list, an empty
    one or up to four codes, some twice; every eleventh names a motor that is not there."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    key = F.col("o_orderkey")
    codes = F.array(*[F.lit(c) for c in CHECKLIST_CODES])
    listed = F.filter(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: F.when(
        j < key % 6, F.element_at(codes, ((key + F.floor(j / 2)) % len(CHECKLIST_CODES) + 1).cast("int")))), lambda c: c.isNotNull())
    serial = serial_of(F.col("o_custkey"))
    return o.select(key.alias("request_id"), F.when(key % 11 == 0, F.concat(F.lit("ZZ"), serial)).otherwise(serial).alias("serial_no"),
                    F.when(key % 6 != 0, listed).alias("checklist"))


# FIXED VALUES — multipliers of the two deterministic stand-in "models"
PRIMARY_MULTIPLIERS = (31, 37, 41, 43)
SECONDARY_MULTIPLIERS = (47, 53, 59, 61)


def motor_weights(serial: Column, multipliers=PRIMARY_MULTIPLIERS) -> list[Column]:
    ck = custkey_of(serial)
    return [F.lit(1.0) + (ck * m) % 97 for m in multipliers]


def with_fixture_scores(df: DataFrame, serial_col: str = "equipment_serial_no",
                        multipliers=PRIMARY_MULTIPLIERS) -> DataFrame:
    """Deterministic stand-in for model output: p_low..p_critical and argmax class."""
    return with_weighted_classes(df, motor_weights(F.col(serial_col), multipliers))


# FIXED VALUES — what one unit of each feature adds to the key of the what-if stand-in
WHATIF_FEATURES = {"repair_count": 1, "bearing_failure_count": 2, "winding_failure_count": 3, "rotor_failure_count": 5,
                   "insulation_failure_count": 7, "previous_refurb_count": 11, "days_since_last_repair": 13}


def with_feature_scores(df: DataFrame) -> DataFrame:
    """Stand-in for model output that depends on the features a checklist changes."""
    key = F.lit(0).cast("long")
    for name, unit in WHATIF_FEATURES.items():
        key = key + F.coalesce(F.col(name).cast("long"), F.lit(0)) * unit
    return with_weighted_classes(df, [F.lit(1.0) + (key * m) % 97 for m in PRIMARY_MULTIPLIERS])


def with_weighted_classes(df: DataFrame, weights: list[Column]) -> DataFrame:
    """Class probabilities in proportion to four weights, and the class of the largest."""
    w0, w1, w2, w3 = weights
    total = w0 + w1 + w2 + w3
    risk_class = (F.when((w0 >= w1) & (w0 >= w2) & (w0 >= w3), 0)
                  .when((w1 >= w2) & (w1 >= w3), 1)
                  .when(w2 >= w3, 2).otherwise(3))
    return df.withColumns({
        "p_low": w0 / total, "p_medium": w1 / total, "p_high": w2 / total, "p_critical": w3 / total,
        "risk_class": risk_class.cast("int"),
    })


def labelled_models(spark: SparkSession, sf_dir: str, multipliers: dict[str, tuple[int, ...]]) -> DataFrame:
    """Held-out style rows ``(model, id, label, prediction, prob[4])`` with a known truth,
    for each named stand-in; the motors are read once."""
    ck = F.col("o_custkey")
    rows = read_table(spark, sf_dir, "orders", ["o_custkey"]).distinct().withColumn("serial", serial_of(ck))
    names = ["p_low", "p_medium", "p_high", "p_critical"]
    for model, m in multipliers.items():
        scored = with_fixture_scores(rows, "serial", m)
        rows = scored.withColumn(f"_{model}", F.struct(F.lit(model).alias("model"), F.col("risk_class").alias("prediction"), F.array(*names).alias("prob"))).drop("risk_class", *names)
    return rows.select(ck.alias("id"), ((ck * 7 + F.expr("o_custkey div 3")) % 4).cast("int").alias("label"),
                       F.inline(F.array(*[F.col(f"_{model}") for model in multipliers])))
