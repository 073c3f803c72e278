"""Registered dashboard and registry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlytics import oracle as O
from motorlytics import schema as S
from motorlytics.operators import dashboards as DB
from motorlytics.operators import scoring as SC
from motorlytics.sources import fixtures as FX
from motorlytics.registry.core import ORACLE, engineered, latest, register, requisition
from motorlytics.registry.scoring import scored


# ---------------------------------------------------------------------------
# D — dashboards and registry
# ---------------------------------------------------------------------------


@register("d01_motor_list", O.with_ctes(
    "SELECT DISTINCT equipment_serial_no FROM requisition WHERE equipment_serial_no IS NOT NULL", "requisition"))
def d01(spark, sf_dir):
    return DB.motor_list(requisition(spark, sf_dir))


def lookup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lookup per customer; every tenth asks for a serial that does not exist."""
    from motorlytics.sources.tables import read_table
    ck = F.col("c_custkey")
    prefix = F.when(ck % 10 == 0, F.lit("ZZ")).otherwise(F.lit("EQ"))
    return read_table(spark, sf_dir, "customer", ["c_custkey"]).select(
        F.concat(prefix, F.lpad(ck.cast("string"), 7, "0")).alias("serial_no"))


@register("d02_motor_lookup", O.with_ctes(
    "SELECT r.serial_no, l.equipment_serial_no IS NOT NULL AS found, "
    "CASE WHEN l.equipment_serial_no IS NULL THEN 'Motor ' || r.serial_no || ' not found' END AS error, "
    "l.equipment_type_text, l.make, l.installed_location, l.kw FROM "
    "(SELECT (CASE WHEN c_custkey % 10 = 0 THEN 'ZZ' ELSE 'EQ' END) || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS serial_no "
    "FROM customer) r LEFT JOIN latest l ON r.serial_no = l.equipment_serial_no", "latest"))
def d02(spark, sf_dir):
    return DB.motor_lookup(lookup_requests(spark, sf_dir), latest(spark, sf_dir))


@register("d02_missing_motors", O.with_ctes(
    "SELECT serial_no FROM (SELECT (CASE WHEN c_custkey % 10 = 0 THEN 'ZZ' ELSE 'EQ' END) || "
    "lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS serial_no FROM customer) r "
    "WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.equipment_serial_no = r.serial_no)", "latest"))
def d02_missing(spark, sf_dir):
    return DB.missing_motors(lookup_requests(spark, sf_dir), latest(spark, sf_dir))


O.add_cte("inspection_items", f"""
SELECT o_orderkey AS item_id, 'EQ' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS serial_no,
       {O.pick_sql(FX.CHECKLIST_CODES, 'o_orderkey')} AS code FROM orders
""")


def _in_sql(codes) -> str:
    return "(" + ", ".join(O._q(c) for c in codes) + ")"


_D3_COLS = ["bearing_failure_count", "winding_failure_count", "rotor_failure_count", "insulation_failure_count",
            "repair_count", "previous_refurb_count", "days_since_last_repair"]


@register("d03_checklist_adjust", O.with_ctes(f"""
SELECT c.serial_no, l.equipment_serial_no IS NOT NULL AS found,
  l.bearing_failure_count + c.add_bearing AS bearing_failure_count,
  l.winding_failure_count + c.add_winding AS winding_failure_count,
  l.rotor_failure_count + c.add_rotor AS rotor_failure_count,
  l.insulation_failure_count + c.add_insulation AS insulation_failure_count,
  CAST(l.repair_count + c.add_general AS BIGINT) AS repair_count,
  l.previous_refurb_count + c.add_general AS previous_refurb_count,
  CAST(CASE WHEN c.add_general > 0 THEN least(l.days_since_last_repair, {S.CHECKLIST_GAP_CAP_DAYS})
       ELSE l.days_since_last_repair END AS INTEGER) AS days_since_last_repair
FROM (SELECT serial_no,
        count(*) FILTER (WHERE code IN {_in_sql(S.CHECKLIST_BEARING)}) AS add_bearing,
        count(*) FILTER (WHERE code IN {_in_sql(S.CHECKLIST_WINDING)}) AS add_winding,
        count(*) FILTER (WHERE code IN {_in_sql(S.CHECKLIST_ROTOR)}) AS add_rotor,
        count(*) FILTER (WHERE code IN {_in_sql(S.CHECKLIST_INSULATION)}) AS add_insulation,
        count(*) FILTER (WHERE code IN {_in_sql(S.CHECKLIST_GENERAL)}) AS add_general
      FROM inspection_items GROUP BY serial_no) c
LEFT JOIN latest l ON c.serial_no = l.equipment_serial_no""", "inspection_items", "latest"))
def d03(spark, sf_dir):
    counts = DB.checklist_counts(FX.inspection_items(spark, sf_dir))
    return DB.apply_checklist(latest(spark, sf_dir), counts).select("serial_no", "found", *_D3_COLS)


_REGISTRY_COLS = ["equipment_id", "allotment", "main_equipment_name", "equipment_serial_no", "motor_manufacturing_year",
                  "make", "model", "kw", "frame", "rpm", "voltage", "installed_location", "status", "health_score",
                  "predicted_risk"]
O.add_cte("registry", """
SELECT requisition_id AS equipment_id,
  CASE WHEN (row_number() OVER (ORDER BY equipment_serial_no) - 1) % 3 = 0 THEN 'dr' ELSE '' END AS allotment,
  coalesce(equipment_type_text, 'N/A') AS main_equipment_name, equipment_serial_no,
  coalesce(motor_manufacturing_year, 2020) AS motor_manufacturing_year, coalesce(make, 'N/A') AS make,
  coalesce(model, 'N/A') AS model, coalesce(kw, 0e0) AS kw, coalesce(frame, 'N/A') AS frame, coalesce(rpm, 0) AS rpm,
  coalesce(voltage, 0) AS voltage, coalesce(installed_location, 'N/A') AS installed_location,
  coalesce(status, 'N/A') AS status, health_score, predicted_risk
FROM scored
""")


@register("d04_equipment_registry", O.with_ctes("SELECT * FROM registry", "registry"))
def d04(spark, sf_dir):
    return DB.equipment_registry(scored(spark, sf_dir), DB.motor_list(engineered(spark, sf_dir)))


@register("d05_allotment_flag", O.with_ctes("SELECT equipment_serial_no, allotment FROM registry", "registry"))
def d05(spark, sf_dir):
    return DB.with_allotment(DB.motor_list(requisition(spark, sf_dir)))


SEARCH_QUERY = "Nation_1"


@register("d06_registry_search", O.with_ctes(
    "SELECT * FROM registry WHERE " + " OR ".join(
        f"coalesce(contains(lower({c}), lower('{SEARCH_QUERY}')), false)" for c in DB.SEARCH_COLUMNS), "registry"))
def d06(spark, sf_dir):
    reg = DB.equipment_registry(scored(spark, sf_dir), DB.motor_list(engineered(spark, sf_dir)))
    return DB.registry_search(reg, SEARCH_QUERY)


def _cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


_WORK_UP_SQL = _in_sql(S.STATUS_WORK_UP)


@register("d07_queue_status", O.with_ctes(f"""
SELECT yet + work AS ers_pending, usr AS user_pending, yet AS yet_to_start, work AS work_up, closed AS repaired_closed,
       yet + work AS lt_received, usr + closed AS lt_repaired
FROM (SELECT {_cnt("status = 'RECEIVED'")} AS yet, {_cnt(f"status IN {_WORK_UP_SQL}")} AS work,
             {_cnt("status = 'DISPATCHED'")} AS usr, {_cnt("status = 'CLOSED'")} AS closed FROM requisition)""",
    "requisition"))
def d07(spark, sf_dir):
    return DB.queue_status(requisition(spark, sf_dir))


@register("d08_dispatched_breakdown", O.with_ctes(f"""
SELECT dispatched, bearings_required, spares_required, dispatched - bearings_required - spares_required AS mechanical_jobs
FROM (SELECT {_cnt("status = 'DISPATCHED'")} AS dispatched,
        {_cnt("status = 'DISPATCHED' AND coalesce(regexp_matches(service_type_text, 'bearing', 'i'), false)")} AS bearings_required,
        {_cnt("status = 'DISPATCHED' AND coalesce(regexp_matches(service_type_text, 'rewinding|insulation', 'i'), false)")}
          AS spares_required FROM requisition)""", "requisition"))
def d08(spark, sf_dir):
    return DB.dispatched_breakdown(requisition(spark, sf_dir))


def _band_sql() -> str:
    arms = []
    for order, _n, lo, hi in S.POWER_BANDS:
        conds = []
        if lo is not None:
            conds.append(f"kw > {lo}e0")
        if hi is not None:
            conds.append(f"kw <= {hi}e0")
        arms.append(f"WHEN {' AND '.join(conds)} THEN {order}")
    return "CASE " + " ".join(arms) + " END"


@register("d09_power_band_stats", O.with_ctes(f"""
SELECT d.band_order, d.category, CAST(coalesce(c.ro, 0) AS BIGINT) AS received_outstanding,
       CAST(coalesce(c.rp, 0) AS BIGINT) AS repaired, CAST(coalesce(c.ae, 0) AS BIGINT) AS at_ers
FROM (VALUES {', '.join(f'({o}, {O._q(n)})' for o, n, _, _ in S.POWER_BANDS)}) d(band_order, category)
LEFT JOIN (SELECT band_order, {_cnt("status IS DISTINCT FROM 'CLOSED'")} AS ro,
             {_cnt(f"status IN {_in_sql(S.STATUS_DONE)}")} AS rp, {_cnt(f"status IN {_in_sql(S.STATUS_AT_SHOP)}")} AS ae
           FROM (SELECT *, {_band_sql()} AS band_order FROM requisition) WHERE band_order IS NOT NULL GROUP BY band_order) c
ON c.band_order = d.band_order""", "requisition"))
def d09(spark, sf_dir):
    return DB.power_band_stats(spark, requisition(spark, sf_dir))


def _turnaround_sql(pattern: str, bands, prefix: str) -> str:
    cols = []
    for name, lo, hi in bands:
        conds = ["true"]
        if lo is not None:
            conds.append(f"dur > {lo}")
        if hi is not None:
            conds.append(f"dur <= {hi}")
        cols.append(f"{_cnt(' AND '.join(conds))} AS {prefix}_{name}")
    names = [f"{prefix}_{b[0]}" for b in bands]
    return O.with_ctes(f"""
SELECT *, {' + '.join(names)} AS {prefix}_total FROM (
  SELECT {', '.join(cols)} FROM (
    SELECT coalesce(datediff('day', received_date, CAST(updated_at AS DATE)), 0) AS dur FROM requisition
    WHERE status IN {_in_sql(S.STATUS_DONE)} AND coalesce(regexp_matches(service_type_text, '{pattern}', 'i'), false)))""",
                       "requisition")


@register("d10_turnaround_rewinding", _turnaround_sql(S.REWINDING_PATTERN, S.REWINDING_BANDS, "rew"))
def d10(spark, sf_dir):
    return DB.turnaround_rewinding(requisition(spark, sf_dir))


@register("d11_turnaround_overhauling", _turnaround_sql(S.OVERHAUL_PATTERN, S.OVERHAUL_BANDS, "ovh"))
def d11(spark, sf_dir):
    return DB.turnaround_overhauling(requisition(spark, sf_dir))


_BAND_FIELDS = ["received_outstanding", "repaired", "at_ers"]


def _combined_sql() -> str:
    bands = ", ".join(f"max({n}) FILTER (WHERE band_order = {o}) AS band{o}_{n}" for o, *_ in S.POWER_BANDS for n in _BAND_FIELDS)
    return (f"SELECT q.ers_pending, q.user_pending, q.yet_to_start, q.work_up, b.mechanical_jobs, b.spares_required, b.bearings_required, "
            f"q.lt_received, q.lt_repaired, p.*, r.*, o.* FROM ({ORACLE['d07_queue_status']}) q CROSS JOIN ({ORACLE['d08_dispatched_breakdown']}) b "
            f"CROSS JOIN (SELECT {bands} FROM ({ORACLE['d09_power_band_stats']})) p CROSS JOIN ({ORACLE['d10_turnaround_rewinding']}) r "
            f"CROSS JOIN ({ORACLE['d11_turnaround_overhauling']}) o")


@register("d12_combined_dashboard", _combined_sql())
def d12(spark, sf_dir):
    """The nested record, flattened for comparison."""
    rec, dash = DB.combined_dashboard(requisition(spark, sf_dir)), F.col("dashboard")
    return rec.select(
        dash["pending_status"]["ers"].alias("ers_pending"), dash["pending_status"]["user_dept"].alias("user_pending"), "dashboard.pending_ers.*",
        "dashboard.pending_user.*", dash["lt_motors"]["received"].alias("lt_received"), dash["lt_motors"]["repaired"].alias("lt_repaired"),
        *[F.col("categories")[i][n].alias(f"band{o}_{n}") for i, (o, *_) in enumerate(S.POWER_BANDS) for n in _BAND_FIELDS],
        *[F.col("turnaround")[k][n].alias(f"{prefix}_{n}") for k, prefix, bands in (("rewinding", "rew", S.REWINDING_BANDS), ("overhauling", "ovh", S.OVERHAUL_BANDS))
          for n in [*(b[0] for b in bands), "total"]])


@register("d13_fleet_summary")
def d13(spark, sf_dir):
    return SC.fleet_summary_record(spark, scored(spark, sf_dir))


def _percent_long_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT equipment_serial_no, {O._q(name)} AS component, {c} AS probability, round({c} * 100e0, 1) AS percent "
        f"FROM scored_components" for name, c in SC.COMPONENT_COLUMNS.items())
    return parts


O.add_cte("component_percent", _percent_long_sql())


def _advisory_values_sql() -> str:
    return "(VALUES " + ", ".join(f"({O._q(c)}, {lvl}, {O._q(t)})" for c, lvl, t in S.ADVISORIES) + \
        ") a(component, level, advisory)"


@register("d14_component_advisory", O.with_ctes(f"""
SELECT p.*, a.advisory FROM (
  SELECT *, CAST(CASE WHEN percent > {S.ADVISORY_HIGH_PCT} THEN 2 WHEN percent > {S.ADVISORY_MODERATE_PCT} THEN 1 ELSE 0 END
                 AS INTEGER) AS level FROM component_percent) p
LEFT JOIN {_advisory_values_sql()} ON a.component = p.component AND a.level = p.level""", "component_percent"))
def d14(spark, sf_dir):
    s = scored(spark, sf_dir).transform(SC.add_component_probabilities)
    return DB.component_advisories(spark, s, SC.COMPONENT_COLUMNS)


@register("d15_percent_display", O.with_ctes("SELECT * FROM component_percent", "component_percent"))
def d15(spark, sf_dir):
    s = scored(spark, sf_dir).transform(SC.add_component_probabilities)
    return DB.component_percentages(s, SC.COMPONENT_COLUMNS)


@register("d16_manufacturing_year_display", O.with_ctes(
    f"SELECT equipment_serial_no, CASE WHEN motor_age_years IS NOT NULL AND motor_age_years <> 0 "
    f"THEN CAST({S.DEFAULT_AS_OF_YEAR} - motor_age_years AS VARCHAR) ELSE 'N/A' END AS manufacturing_year FROM latest",
    "latest"))
def d16(spark, sf_dir):
    return DB.manufacturing_year_display(latest(spark, sf_dir))


@register("d17_weekly_received_repaired", O.with_ctes("""
SELECT strftime(g.week_start, '%Y-%m-%d') AS week_start, CAST(coalesce(r.n, 0) AS BIGINT) AS received,
       CAST(coalesce(p.n, 0) AS BIGINT) AS repaired
FROM (SELECT CAST(unnest(generate_series(last_w - INTERVAL 49 DAY, last_w, INTERVAL 7 DAY)) AS DATE) AS week_start
      FROM (SELECT max(w) AS last_w FROM (
              SELECT CAST(date_trunc('week', received_date) AS DATE) AS w FROM requisition WHERE received_date IS NOT NULL
              UNION ALL SELECT CAST(date_trunc('week', updated_at) AS DATE) FROM requisition
              WHERE status IN ('CLOSED', 'DISPATCHED') AND updated_at IS NOT NULL))) g
LEFT JOIN (SELECT CAST(date_trunc('week', received_date) AS DATE) AS w, count(*) AS n FROM requisition
           WHERE received_date IS NOT NULL GROUP BY 1) r ON r.w = g.week_start
LEFT JOIN (SELECT CAST(date_trunc('week', updated_at) AS DATE) AS w, count(*) AS n FROM requisition
           WHERE status IN ('CLOSED', 'DISPATCHED') AND updated_at IS NOT NULL GROUP BY 1) p ON p.w = g.week_start""",
    "requisition"))
def d17(spark, sf_dir):
    return DB.weekly_received_repaired(spark, requisition(spark, sf_dir))


@register("d18_failure_pareto", O.with_ctes("""
SELECT reason_of_failure_text, failure_count, failure_count / total * 100e0 AS pct,
       sum(failure_count) OVER (ORDER BY failure_count DESC, reason_of_failure_text
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / total * 100e0 AS cumulative_pct
FROM (SELECT reason_of_failure_text, count(*) AS failure_count, sum(count(*)) OVER () AS total FROM requisition
      WHERE reason_of_failure_text IS NOT NULL GROUP BY reason_of_failure_text)""", "requisition"))
def d18(spark, sf_dir):
    return DB.failure_pareto(requisition(spark, sf_dir))


@register("d19_pending_by_department", O.with_ctes(
    f"SELECT installed_location, count(*) AS pending_count FROM requisition WHERE status IN {_in_sql(S.STATUS_AT_SHOP)} "
    "AND installed_location IS NOT NULL GROUP BY installed_location", "requisition"))
def d19(spark, sf_dir):
    return DB.pending_by_department(requisition(spark, sf_dir))


