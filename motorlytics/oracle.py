"""Independent SQL (DuckDB dialect) for the correctness oracle.

Each registered query has a SQL twin built from the common table expressions
below. They are written from the operator semantics, not from the Spark
plans: plain windows over whole partitions, DISTINCT, GROUP BY and CASE.
Literals are written as ``1e0`` style doubles so both engines do the same
IEEE arithmetic, and rounding uses ``round_even`` on the scaled value to match
numpy's scale-then-round-half-even.
"""

from __future__ import annotations

import math

from motorlytics import schema as S
from motorlytics.functions.expr import DRAW_DIGITS
from motorlytics.sources import fixtures as FX


def _q(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def pick_sql(values: list, key: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"(CASE ({key}) % {len(values)} {arms} END)"


def np_round_sql(expr: str, digits: int) -> str:
    scale = f"{10 ** digits}e0"
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def clip_sql(expr: str, lo: str | None, hi: str | None) -> str:
    out = expr
    if lo is not None:
        out = f"greatest({out}, {lo})"
    if hi is not None:
        out = f"least({out}, {hi})"
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE {out} END)"


def clip01_sql(expr: str) -> str:
    return clip_sql(expr, "0e0", "1e0")


def _status_sql() -> str:
    arms = " ".join(
        f"WHEN o_orderstatus = {_q(code)} THEN (CASE WHEN o_orderkey % 2 = 0 THEN {_q(a)} ELSE {_q(b)} END)"
        for code, (a, b) in FX.STATUS_BY_ORDER_STATUS.items())
    return f"(CASE {arms} END)"


REQUISITION = f"""
SELECT
  o_orderkey AS requisition_id,
  'EQ' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS equipment_serial_no,
  CAST(1995 + o_custkey % 29 AS INTEGER) AS motor_manufacturing_year,
  n_name AS installed_location,
  c_mktsegment AS make,
  {pick_sql(FX.EQUIPMENT_TYPES, 'o_custkey')} AS equipment_type_text,
  {pick_sql(FX.EQUIPMENT_TYPES, 'o_custkey')} AS main_equipment_name,
  0.75e0 + (o_custkey % 200) * 2.5e0 AS kw,
  CAST({pick_sql(FX.RPMS, 'o_custkey')} AS INTEGER) AS rpm,
  CAST(CASE WHEN o_custkey % 200 < 3 THEN 415 WHEN o_custkey % 200 < 53 THEN 3300 ELSE 6600 END AS INTEGER) AS voltage,
  (0.75e0 + (o_custkey % 200) * 2.5e0) * 1000e0
    / (1.7320508e0 * CAST(CASE WHEN o_custkey % 200 < 3 THEN 415 WHEN o_custkey % 200 < 53 THEN 3300 ELSE 6600 END AS DOUBLE) * 0.87e0) AS current,
  {pick_sql(FX.DUTY_CYCLES, 'o_custkey')} AS duty_cycle,
  'Use ' || CAST(o_custkey % 9 AS VARCHAR) AS application_use,
  'M' || CAST(100 + o_custkey % 900 AS VARCHAR) AS model,
  'D' || CAST(80 + o_custkey % 20 AS VARCHAR) AS frame,
  {_status_sql()} AS status,
  {pick_sql(FX.FAILURE_REASONS, 'o_orderkey')} AS reason_of_failure_text,
  {pick_sql(FX.SERVICE_TYPES, 'o_orderkey')} AS service_type_text,
  CASE WHEN o_orderkey % 5 < 2 THEN '' WHEN o_orderkey % 5 = 2 THEN NULL
       ELSE 'JOB-' || CAST(10000 + o_orderkey % 90000 AS VARCHAR) END AS previous_refurbishment_job_no,
  CAST(o_orderdate AS DATE) AS received_date,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INTEGER) AS TIMESTAMP) AS updated_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

_W = "PARTITION BY equipment_serial_no ORDER BY received_date ASC NULLS LAST, requisition_id"
_WC = _W + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _failure_running() -> str:
    return ",\n  ".join(
        f"CAST(sum(CASE WHEN reason_of_failure_text = {_q(reason)} THEN 1 ELSE 0 END) OVER ({_WC}) AS BIGINT) AS {col}"
        for reason, col in S.TRACKED_FAILURES.items())


HISTORY = f"""
SELECT r.*,
  CAST({S.DEFAULT_AS_OF_YEAR} - motor_manufacturing_year AS INTEGER) AS motor_age_years,
  CAST(row_number() OVER ({_W}) AS BIGINT) AS repair_count,
  CAST(coalesce(datediff('day', lag(received_date) OVER ({_W}), received_date), {S.FIRST_REPAIR_GAP_DAYS}) AS INTEGER)
    AS days_since_last_repair,
  CAST(sum(CASE WHEN coalesce(previous_refurbishment_job_no, '') <> '' THEN 1 ELSE 0 END) OVER ({_WC}) AS BIGINT)
    AS previous_refurb_count,
  {_failure_running()}
FROM requisition r
"""

DEPT_RATE = """
SELECT installed_location, CAST(count(requisition_id) AS DOUBLE) / count(DISTINCT equipment_serial_no) AS dept_failure_rate
FROM requisition WHERE installed_location IS NOT NULL GROUP BY installed_location
"""

MAKE_RATE = """
SELECT make, CAST(count(requisition_id) AS DOUBLE) / count(DISTINCT equipment_serial_no) AS make_failure_rate
FROM requisition WHERE make IS NOT NULL GROUP BY make
"""


def _encoder_sql() -> str:
    parts = " UNION ".join(
        f"SELECT {_q(c)} AS \"column\", coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM requisition"
        for c in S.CATEGORICAL_COLUMNS)
    return (f"SELECT \"column\", value, CAST(dense_rank() OVER (PARTITION BY \"column\" ORDER BY value) - 1 AS INTEGER) AS code "
            f"FROM ({parts}) d")


ENCODERS = _encoder_sql()


def _encoded_sql() -> str:
    joins, cols = [], []
    for i, (src, dst) in enumerate(S.CATEGORICAL_COLUMNS.items()):
        joins.append(f"LEFT JOIN encoders e{i} ON e{i}.\"column\" = {_q(src)} "
                     f"AND e{i}.value = coalesce(CAST(h.{src} AS VARCHAR), 'nan')")
        cols.append(f"CAST(coalesce(e{i}.code, {S.UNSEEN_CODE}) AS INTEGER) AS {dst}")
    return (f"SELECT h.*, d.dept_failure_rate, m.make_failure_rate, {', '.join(cols)}\n"
            f"FROM history h LEFT JOIN dept_rate d ON h.installed_location = d.installed_location\n"
            f"LEFT JOIN make_rate m ON h.make = m.make\n" + "\n".join(joins))


ENCODED = _encoded_sql()


def _components_sql() -> str:
    fails = " + ".join(S.TRACKED_FAILURES.values())
    return f"""
SELECT e.*,
  {clip01_sql(f'motor_age_years / {S.AGE_SCALE_YEARS}')} AS age_score,
  {clip01_sql(f'repair_count / {S.REPAIR_SCALE}')} AS repair_freq_score,
  {clip01_sql(f'1e0 - days_since_last_repair / {S.RECENCY_SCALE_DAYS}')} AS recency_score,
  {clip01_sql(f'kw / {S.KW_SCALE}')} AS kw_score,
  {clip01_sql(f'(0 + {fails}) / {S.FAILURE_SCALE}')} AS failure_history_score
FROM encoded e
"""


COMPONENTS = _components_sql()


def draw_sql(seed: int, col: str) -> str:
    """Twin of ``functions.expr.draw_bits``."""
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, {DRAW_DIGITS}) AS BIGINT)"


def uniform_sql(seed: int, col: str) -> str:
    return f"(CAST({draw_sql(seed, col)} AS DOUBLE) / {float(16 ** DRAW_DIGITS)!r}::DOUBLE)"


def normal_sql(seed: int, col: str) -> str:
    return f"(sqrt(-2e0 * ln(1e0 - {uniform_sql(seed, col)})) * cos({2 * math.pi!r}::DOUBLE * {uniform_sql(seed + 7919, col)}))"


def _scored_sql(noise: str = "") -> str:
    w = S.RISK_WEIGHTS
    score = (f"{w['age']}e0 * age_score + {w['repairs']}e0 * repair_freq_score + {w['recency']}e0 * recency_score"
             f" + {w['kw']}e0 * kw_score + {w['failures']}e0 * failure_history_score{noise}")
    return f"SELECT c.*, {clip01_sql(score)} AS risk_score FROM components c"


RISK = _scored_sql()


def _features_sql(risk: str = "risk") -> str:
    t0, t1, t2 = S.RISK_THRESHOLDS
    cat = (f"CAST(CASE WHEN risk_score IS NULL THEN 1 WHEN risk_score < {t0}e0 THEN 0 WHEN risk_score < {t1}e0 THEN 1 "
           f"WHEN risk_score < {t2}e0 THEN 2 ELSE 3 END AS INTEGER)")
    labels = " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in sorted(S.RISK_LABELS.items()))
    return f"""
SELECT * EXCLUDE (age_score, repair_freq_score, recency_score, kw_score, failure_history_score, risk_score, cat_),
  (CASE cat_ {labels} END) AS risk_label, cat_ AS risk_category
FROM (SELECT *, {np_round_sql('(1e0 - risk_score) * 100e0', 1)} AS health_score, {cat} AS cat_ FROM {risk})
"""


FEATURES = _features_sql()

# ordered: each CTE may use the ones before it
CTES: dict[str, str] = {
    "requisition": REQUISITION,
    "history": HISTORY,
    "dept_rate": DEPT_RATE,
    "make_rate": MAKE_RATE,
    "encoders": ENCODERS,
    "encoded": ENCODED,
    "components": COMPONENTS,
    "risk": RISK,
    "features": FEATURES,
    "risk_noise": _scored_sql(f" + 0.05e0 * {normal_sql(42, 'requisition_id')}"),
    "features_noise": _features_sql("risk_noise"),
}


def add_cte(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(body: str, *needs: str) -> str:
    """Prefix ``body`` with the named CTEs and everything they depend on."""
    names = list(CTES)
    wanted: set[str] = set()

    def need(n: str) -> None:
        if n in wanted:
            return
        wanted.add(n)
        text = CTES[n]
        for other in names[: names.index(n)]:
            if _mentions(text, other):
                need(other)

    for n in needs:
        need(n)
    ordered = [n for n in names if n in wanted]
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" + body


def _mentions(text: str, name: str) -> bool:
    import re
    return re.search(rf"\b(FROM|JOIN)\s+{re.escape(name)}\b", text) is not None
