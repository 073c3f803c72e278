"""Dashboard and registry queries.

Each dashboard block is a single scan with conditional aggregates, instead of
one pass per number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlytics import schema as S
from motorlytics.functions.expr import contains_ci, count_if, js_round, not_equal_null_true
from motorlytics.plans.ordering import global_prefix

SERIAL = "equipment_serial_no"


# D1 ------------------------------------------------------------------------
def motor_list(df: DataFrame) -> DataFrame:
    return df.where(F.col(SERIAL).isNotNull()).select(SERIAL).distinct()


# D2 ------------------------------------------------------------------------
def motor_lookup(requests: DataFrame, motors: DataFrame, request_col: str = "serial_no",
                 columns: tuple[str, ...] = ("equipment_type_text", "make", "installed_location", "kw")) -> DataFrame:
    """Look a batch of serials up; unknown ones get ``found=false`` and an error text."""
    m = motors.select(F.col(SERIAL).alias("_m_serial"), *columns)
    j = requests.join(m, requests[request_col] == m["_m_serial"], "left")
    found = F.col("_m_serial").isNotNull()
    return j.select(
        F.col(request_col).alias("serial_no"), found.alias("found"),
        F.when(~found, F.concat(F.lit("Motor "), F.col(request_col), F.lit(" not found"))).alias("error"),
        *columns)


def missing_motors(requests: DataFrame, motors: DataFrame, request_col: str = "serial_no") -> DataFrame:
    """Requested serials with no motor record (anti join)."""
    m = motors.select(F.col(SERIAL).alias("_m_serial"))
    return requests.join(m, requests[request_col] == m["_m_serial"], "left_anti").select(
        F.col(request_col).alias("serial_no"))


# D3 ------------------------------------------------------------------------
def checklist_counts(items: DataFrame, key: str = "serial_no", code_col: str = "code") -> DataFrame:
    """Per request key, how many listed codes hit each rule (with multiplicity).
    Works on long-form items; array-form requests are exploded first
    (``explode_checklists``). Partial aggregation keeps a hot key cheap."""
    code = F.col(code_col)
    return items.groupBy(key).agg(
        count_if(code.isin(S.CHECKLIST_BEARING)).alias("add_bearing"),
        count_if(code.isin(S.CHECKLIST_WINDING)).alias("add_winding"),
        count_if(code.isin(S.CHECKLIST_ROTOR)).alias("add_rotor"),
        count_if(code.isin(S.CHECKLIST_INSULATION)).alias("add_insulation"),
        count_if(code.isin(S.CHECKLIST_GENERAL)).alias("add_general"),
    )


def explode_checklists(requests: DataFrame, key: str = "serial_no") -> DataFrame:
    return requests.select(key, F.explode_outer("checklist").alias("code"))


def apply_checklist(motors: DataFrame, counts: DataFrame, key: str = "serial_no") -> DataFrame:
    """What-if features: each motor's latest record bumped by its checklist.
    Requests whose motor does not exist come back with ``found=false``."""
    m = motors.withColumnRenamed(SERIAL, "_m_serial")
    j = counts.join(m, counts[key] == m["_m_serial"], "left")
    gen = F.col("add_general")
    adjusted = {
        "bearing_failure_count": F.col("bearing_failure_count") + F.col("add_bearing"),
        "winding_failure_count": F.col("winding_failure_count") + F.col("add_winding"),
        "rotor_failure_count": F.col("rotor_failure_count") + F.col("add_rotor"),
        "insulation_failure_count": F.col("insulation_failure_count") + F.col("add_insulation"),
        "repair_count": (F.col("repair_count") + gen).cast("long"),
        "previous_refurb_count": F.col("previous_refurb_count") + gen,
        "days_since_last_repair": F.when(gen > 0, F.least(F.col("days_since_last_repair"),
                                                          F.lit(S.CHECKLIST_GAP_CAP_DAYS)))
                                   .otherwise(F.col("days_since_last_repair")).cast("int"),
    }
    return (j.withColumns(adjusted).withColumn("found", F.col("_m_serial").isNotNull())
            .drop("_m_serial", "add_bearing", "add_winding", "add_rotor", "add_insulation", "add_general"))


# D5 ------------------------------------------------------------------------
def with_allotment(df: DataFrame, serials: DataFrame | None = None) -> DataFrame:
    """'dr' on every third motor in serial order (0-based position % 3 == 0).
    The position comes from a range-bucketed prefix count, not a global window.
    ``serials`` (distinct, same set as ``df``'s) may come from a cheaper plan."""
    keys = serials if serials is not None else df.select(SERIAL)
    pos = global_prefix(keys.select(SERIAL), [SERIAL], "_pos")
    flagged = pos.select(SERIAL, F.when((F.col("_pos") - 1) % 3 == 0, F.lit("dr")).otherwise(F.lit("")).alias("allotment"))
    return df.join(flagged, SERIAL, "left")


# D4 ------------------------------------------------------------------------
def equipment_registry(scored: DataFrame, serials: DataFrame | None = None) -> DataFrame:
    """Registry rows from scored motors, with the display defaults."""
    na = F.lit("N/A")
    reg = with_allotment(scored, serials)
    return reg.select(
        F.col("requisition_id").alias("equipment_id"),
        "allotment",
        F.coalesce(F.col("equipment_type_text"), na).alias("main_equipment_name"),
        F.col(SERIAL),
        F.coalesce(F.col("motor_manufacturing_year"), F.lit(2020)).alias("motor_manufacturing_year"),
        F.coalesce(F.col("make"), na).alias("make"),
        F.coalesce(F.col("model"), na).alias("model"),
        F.coalesce(F.col("kw"), F.lit(0.0)).alias("kw"),
        F.coalesce(F.col("frame"), na).alias("frame"),
        F.coalesce(F.col("rpm"), F.lit(0)).alias("rpm"),
        F.coalesce(F.col("voltage"), F.lit(0)).alias("voltage"),
        F.coalesce(F.col("installed_location"), na).alias("installed_location"),
        F.coalesce(F.col("status"), na).alias("status"),
        F.col("health_score"),
        F.col("predicted_risk"),
    )


# D6 ------------------------------------------------------------------------
SEARCH_COLUMNS = (SERIAL, "make", "model", "main_equipment_name", "installed_location")


def registry_search(registry: DataFrame, query: str) -> DataFrame:
    """Case-insensitive literal substring match on any of five columns."""
    q = F.lower(F.lit(query))
    hit = F.lit(False)
    for c in SEARCH_COLUMNS:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
    return registry.where(hit)


# D7 / D8 -------------------------------------------------------------------
def _queue_counts() -> list[Column]:
    st = F.col("status")
    return [count_if(st == S.STATUS_RECEIVED).alias("yet_to_start"), count_if(st.isin(S.STATUS_WORK_UP)).alias("work_up"),
            count_if(st == S.STATUS_DISPATCHED).alias("user_pending"), count_if(st == S.STATUS_CLOSED).alias("repaired_closed")]


def queue_status(df: DataFrame) -> DataFrame:
    return df.agg(*_queue_counts()).select(
        (F.col("yet_to_start") + F.col("work_up")).alias("ers_pending"),
        "user_pending", "yet_to_start", "work_up", "repaired_closed",
        (F.col("yet_to_start") + F.col("work_up")).alias("lt_received"),
        (F.col("user_pending") + F.col("repaired_closed")).alias("lt_repaired"),
    )


def _dispatched_counts() -> list[Column]:
    disp = F.col("status") == S.STATUS_DISPATCHED
    svc = F.col("service_type_text")
    return [count_if(disp).alias("dispatched"),
            count_if(disp & contains_ci(svc, S.BEARING_SERVICE_PATTERN)).alias("bearings_required"),
            count_if(disp & contains_ci(svc, S.SPARES_SERVICE_PATTERN)).alias("spares_required")]


def _mechanical() -> Column:
    return F.col("dispatched") - F.col("bearings_required") - F.col("spares_required")


def dispatched_breakdown(df: DataFrame) -> DataFrame:
    """Dispatched jobs needing bearings / spares (rewinding or insulation);
    mechanical jobs are the rest, by subtraction."""
    return df.agg(*_dispatched_counts()).withColumn("mechanical_jobs", _mechanical())


# D9 ------------------------------------------------------------------------
def power_band_expr(kw: Column) -> Column:
    out = F.lit(None).cast("int")
    for order, _name, lo, hi in reversed(S.POWER_BANDS):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (kw > lo)
        if hi is not None:
            cond = cond & (kw <= hi)
        out = F.when(cond, F.lit(order)).otherwise(out)
    return out


def _band_conditions() -> dict[str, Column]:
    st = F.col("status")
    return {"received_outstanding": not_equal_null_true(st, S.STATUS_CLOSED), "repaired": st.isin(S.STATUS_DONE),
            "at_ers": st.isin(S.STATUS_AT_SHOP)}


def power_band_stats(spark: SparkSession, df: DataFrame) -> DataFrame:
    counts = (df.withColumn("band_order", power_band_expr(F.col("kw")))
              .where(F.col("band_order").isNotNull())
              .groupBy("band_order")
              .agg(*[count_if(c).alias(n) for n, c in _band_conditions().items()]))
    dim = S.power_band_dim(spark)  # three rows by construction
    return (F.broadcast(dim).join(counts, "band_order", "left")
            .select("band_order", "category",
                    *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                      for c in ("received_outstanding", "repaired", "at_ers")]))


# D10 / D11 -----------------------------------------------------------------
def duration_days_expr() -> Column:
    """Whole days from receipt to last update; a missing update counts as 0."""
    return F.coalesce(F.datediff(F.to_date(F.col("updated_at")), F.col("received_date")), F.lit(0))


def _turnaround_rows(pattern: str) -> Column:
    return F.col("status").isin(S.STATUS_DONE) & contains_ci(F.col("service_type_text"), pattern)


def _band_counts(dur: Column, bands, prefix: str, rows: Column | None = None) -> list[Column]:
    cols = []
    for name, lo, hi in bands:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (dur > lo)
        if hi is not None:
            cond = cond & (dur <= hi)
        cols.append(count_if(cond if rows is None else rows & cond).alias(f"{prefix}_{name}"))
    return cols


def _band_total(bands, prefix: str) -> Column:
    total = F.lit(0)
    for b in bands:
        total = total + F.col(f"{prefix}_{b[0]}")
    return total.cast("long")


def turnaround(df: DataFrame, pattern: str, bands, prefix: str) -> DataFrame:
    done = df.where(_turnaround_rows(pattern))
    wide = done.select(duration_days_expr().alias("_dur")).agg(*_band_counts(F.col("_dur"), bands, prefix))
    return wide.withColumn(f"{prefix}_total", _band_total(bands, prefix))


def turnaround_rewinding(df: DataFrame) -> DataFrame:
    return turnaround(df, S.REWINDING_PATTERN, S.REWINDING_BANDS, "rew")


def turnaround_overhauling(df: DataFrame) -> DataFrame:
    return turnaround(df, S.OVERHAUL_PATTERN, S.OVERHAUL_BANDS, "ovh")


# D12 -----------------------------------------------------------------------
def combined_dashboard(df: DataFrame) -> DataFrame:
    """One record: queue status (+ dispatched breakdown), power bands, turnaround; all
    counts come from one aggregate over one scan."""
    band = power_band_expr(F.col("kw"))
    groups = {"rew": (S.REWINDING_PATTERN, S.REWINDING_BANDS), "ovh": (S.OVERHAUL_PATTERN, S.OVERHAUL_BANDS)}
    wide = df.withColumn("_dur", duration_days_expr()).agg(
        *_queue_counts(), *_dispatched_counts(),
        *[count_if((band == order) & c).alias(f"b{order}_{n}") for order, *_ in S.POWER_BANDS for n, c in _band_conditions().items()],
        *[c for prefix, (pattern, bands) in groups.items() for c in _band_counts(F.col("_dur"), bands, prefix, _turnaround_rows(pattern))])
    at_shop = F.col("yet_to_start") + F.col("work_up")
    return wide.select(
        F.struct(
            F.struct(at_shop.alias("ers"), F.col("user_pending").alias("user_dept")).alias("pending_status"),
            F.struct("yet_to_start", "work_up").alias("pending_ers"),
            F.struct(_mechanical().alias("mechanical_jobs"), "spares_required", "bearings_required").alias("pending_user"),
            F.struct(at_shop.alias("received"), (F.col("user_pending") + F.col("repaired_closed")).alias("repaired")).alias("lt_motors"),
        ).alias("dashboard"),
        F.array(*[F.struct(F.lit(name).alias("category"), *[F.col(f"b{order}_{n}").alias(n) for n in _band_conditions()])
                  for order, name, *_ in S.POWER_BANDS]).alias("categories"),
        F.struct(*[F.struct(*[F.col(f"{prefix}_{b[0]}").alias(b[0]) for b in bands], _band_total(bands, prefix).alias("total")).alias(name)
                   for name, (prefix, (_, bands)) in zip(("rewinding", "overhauling"), groups.items(), strict=True)]).alias("turnaround"))


# D14 / D15 -----------------------------------------------------------------
def component_percentages(df: DataFrame, component_cols: dict[str, str]) -> DataFrame:
    """Long form (motor, component, percent) with the display rounding."""
    entries = F.array(*[F.struct(F.lit(name).alias("component"), F.col(c).alias("probability"))
                        for name, c in component_cols.items()])
    return (df.select(SERIAL, F.inline(entries))
            .withColumn("percent", js_round(F.col("probability") * 100.0, 1)))


def advisory_level_expr(pct: Column) -> Column:
    return (F.when(pct > S.ADVISORY_HIGH_PCT, 2).when(pct > S.ADVISORY_MODERATE_PCT, 1).otherwise(0)).cast("int")


def component_advisories(spark: SparkSession, df: DataFrame, component_cols: dict[str, str]) -> DataFrame:
    """Advisory text per motor and component from the 12-row advisory table."""
    pct = component_percentages(df, component_cols).withColumn("level", advisory_level_expr(F.col("percent")))
    return pct.join(F.broadcast(S.advisory_dim(spark)), ["component", "level"], "left")


# D16 -----------------------------------------------------------------------
def manufacturing_year_display(df: DataFrame, as_of_year: int = S.DEFAULT_AS_OF_YEAR) -> DataFrame:
    age = F.col("motor_age_years")
    shown = F.when(age.isNotNull() & (age != 0), (F.lit(as_of_year) - age).cast("string")).otherwise(F.lit("N/A"))
    return df.select(SERIAL, shown.alias("manufacturing_year"))


# D17 -----------------------------------------------------------------------
def weekly_received_repaired(spark: SparkSession, df: DataFrame, weeks: int = 8) -> DataFrame:
    """Received and repaired (closed/dispatched, by update week) per week, for
    the last ``weeks`` weeks of data, every week listed."""
    rec_week = F.to_date(F.date_trunc("week", F.col("received_date").cast("timestamp")))
    upd_week = F.to_date(F.date_trunc("week", F.col("updated_at")))
    seen = F.array(F.struct(rec_week.alias("week_start"), F.lit(1).alias("r"), F.lit(0).alias("d")),
                   F.struct(F.when(F.col("status").isin(S.STATUS_DONE), upd_week).alias("week_start"), F.lit(0).alias("r"), F.lit(1).alias("d")))
    # one scan; a row per week of data, reused for the last week and the counts
    per_week = (df.select(F.inline(seen)).where(F.col("week_start").isNotNull()).groupBy("week_start")
                .agg(F.sum("r").alias("received"), F.sum("d").alias("repaired")))
    listed = per_week.agg(F.max("week_start").alias("_last"), F.map_from_entries(F.collect_list(F.struct(
        "week_start", F.struct("received", "repaired")))).alias("_by_week"))
    grid = listed.select("_by_week", F.explode(F.sequence(F.date_sub(F.col("_last"), 7 * (weeks - 1)), F.col("_last"),
                                                          F.expr("INTERVAL 7 DAYS"))).alias("week_start"))  # `weeks` rows
    at = F.col("_by_week")[F.col("week_start")]
    return grid.select(F.date_format("week_start", "yyyy-MM-dd").alias("week_start"),
                       F.coalesce(at["received"], F.lit(0)).cast("long").alias("received"),
                       F.coalesce(at["repaired"], F.lit(0)).cast("long").alias("repaired"))


# D18 -----------------------------------------------------------------------
def failure_pareto(df: DataFrame) -> DataFrame:
    """Failure reasons by count, descending, with share and cumulative share."""
    counts = (df.where(F.col("reason_of_failure_text").isNotNull())
              .groupBy("reason_of_failure_text").agg(F.count(F.lit(1)).alias("failure_count"))
              .withColumn("_neg", -F.col("failure_count")))
    total = counts.agg(F.sum("failure_count").alias("_total"))
    cum = global_prefix(counts, ["_neg", "reason_of_failure_text"], "_cum", value=F.col("failure_count"))
    return (cum.crossJoin(F.broadcast(total))
            .select("reason_of_failure_text", "failure_count",
                    (F.col("failure_count") / F.col("_total") * 100.0).alias("pct"),
                    (F.col("_cum") / F.col("_total") * 100.0).alias("cumulative_pct")))


# D19 -----------------------------------------------------------------------
def pending_by_department(df: DataFrame) -> DataFrame:
    return (df.where(F.col("status").isin(S.STATUS_AT_SHOP) & F.col("installed_location").isNotNull())
            .groupBy("installed_location").agg(F.count(F.lit(1)).alias("pending_count")))
