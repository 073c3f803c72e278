"""Registered profiling queries."""

from __future__ import annotations

from motorlytics import oracle as O
from motorlytics import schema as S
from motorlytics.operators import profile as PR
from motorlytics.registry.core import _label_values_sql, engineered, register, requisition


# ---------------------------------------------------------------------------
# P — profiling
# ---------------------------------------------------------------------------


@register("p01_dataset_summary", O.with_ctes(
    "SELECT count(*) AS total_records, count(DISTINCT equipment_serial_no) AS unique_motors, "
    "strftime(min(received_date), '%Y-%m-%d') AS first_received, strftime(max(received_date), '%Y-%m-%d') AS last_received, "
    "count(DISTINCT installed_location) AS departments, count(DISTINCT equipment_type_text) AS equipment_types, "
    "count(DISTINCT make) AS makers FROM requisition", "requisition"))
def p01(spark, sf_dir):
    return PR.dataset_summary(requisition(spark, sf_dir))


def _dist_sql(col: str) -> str:
    return O.with_ctes(
        f"SELECT {col}, count(*) AS count, count(*) / (SELECT count(*) FROM requisition) * 100e0 AS pct "
        f"FROM requisition WHERE {col} IS NOT NULL GROUP BY {col}", "requisition")


for _name, _col in [("p02_failure_reason_distribution", "reason_of_failure_text"),
                    ("p03_department_distribution", "installed_location"),
                    ("p04_status_distribution", "status")]:
    register(_name, _dist_sql(_col))(
        (lambda c: (lambda spark, sf_dir: PR.distribution(requisition(spark, sf_dir), c)))(_col))


def _feature_summary_sql(digits: int) -> str:
    parts = []
    for i, c in enumerate(S.FEATURE_COLUMNS):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS feature_order, '{c}' AS feature, {O.np_round_sql(f'avg({x})', digits)} AS mean, "
            f"{O.np_round_sql(f'stddev_samp({x})', digits)} AS std, {O.np_round_sql(f'min({x})', digits)} AS min, "
            f"{O.np_round_sql(f'max({x})', digits)} AS max FROM features")
    return O.with_ctes(" UNION ALL ".join(parts), "features")


@register("p05_feature_summary", _feature_summary_sql(4))
def p05(spark, sf_dir):
    return PR.feature_summary(engineered(spark, sf_dir), digits=4)


@register("p06_target_distribution", O.with_ctes(
    "SELECT d.risk_class, d.risk_label, CAST(coalesce(c.n, 0) AS BIGINT) AS count, "
    "coalesce(c.n, 0) / (SELECT count(*) FROM features) * 100e0 AS pct "
    f"FROM {_label_values_sql()} LEFT JOIN (SELECT risk_category, count(*) AS n FROM features "
    "WHERE risk_category IS NOT NULL GROUP BY risk_category) c ON c.risk_category = d.risk_class", "features"))
def p06(spark, sf_dir):
    return PR.target_distribution(spark, engineered(spark, sf_dir))


@register("p07_health_statistics", O.with_ctes(
    f"SELECT {O.np_round_sql('avg(health_score)', 4)} AS mean, {O.np_round_sql('median(health_score)', 4)} AS median, "
    f"{O.np_round_sql('stddev_samp(health_score)', 4)} AS std, {O.np_round_sql('min(health_score)', 4)} AS min, "
    f"{O.np_round_sql('max(health_score)', 4)} AS max FROM features", "features"))
def p07(spark, sf_dir):
    return PR.health_statistics(engineered(spark, sf_dir), digits=4)


