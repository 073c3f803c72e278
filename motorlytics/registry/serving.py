"""Registered queries of the full checklist response (D3), batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlytics import oracle as O
from motorlytics import schema as S
from motorlytics.sources import fixtures as FX
from motorlytics.sources import io as IO
from motorlytics.sources.manifest import Manifest
from motorlytics.streaming import responses as RS
from motorlytics.registry.core import AS_OF, latest, register
from motorlytics.registry.dashboards import _in_sql
from motorlytics.registry.scoring import _METADATA_SQL, _classes_sql, _components_select_sql, _flat_prediction, _prediction_columns_sql

_METADATA = ["equipment_type", "manufacturer", "installed_location", "kw_rating", "rpm", "age_years"]
#: integers that are null without a motor are shown as text: data frames of the two engines hold null integers differently
_AS_TEXT = ["rpm", "age_years", "risk_class"]
REQUEST_FILES = 3

_codes = "[" + ", ".join(O._q(c) for c in FX.CHECKLIST_CODES) + "]"
O.add_cte("checklist_lists", f"""
SELECT o_orderkey AS request_id, (CASE WHEN o_orderkey % 11 = 0 THEN 'ZZ' ELSE '' END) || 'EQ' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS serial_no,
  CASE WHEN o_orderkey % 6 <> 0
       THEN list_transform(range(1, o_orderkey % 6), lambda j: {_codes}[(o_orderkey + j // 2) % {len(FX.CHECKLIST_CODES)} + 1]) END AS checklist
FROM orders
""")


def _hits_sql(codes: list[str]) -> str:
    return f"coalesce(len(list_filter(checklist, lambda c: c IN {_in_sql(codes)})), 0)"


O.add_cte("whatif_adjusted", f"""
SELECT r.request_id, r.serial_no, l.equipment_serial_no IS NOT NULL AS found, l.* REPLACE (
  l.bearing_failure_count + {_hits_sql(S.CHECKLIST_BEARING)} AS bearing_failure_count,
  l.winding_failure_count + {_hits_sql(S.CHECKLIST_WINDING)} AS winding_failure_count,
  l.rotor_failure_count + {_hits_sql(S.CHECKLIST_ROTOR)} AS rotor_failure_count,
  l.insulation_failure_count + {_hits_sql(S.CHECKLIST_INSULATION)} AS insulation_failure_count,
  l.repair_count + {_hits_sql(S.CHECKLIST_GENERAL)} AS repair_count,
  l.previous_refurb_count + {_hits_sql(S.CHECKLIST_GENERAL)} AS previous_refurb_count,
  CASE WHEN {_hits_sql(S.CHECKLIST_GENERAL)} > 0 THEN least(l.days_since_last_repair, {S.CHECKLIST_GAP_CAP_DAYS})
       ELSE l.days_since_last_repair END AS days_since_last_repair)
FROM checklist_lists r LEFT JOIN latest l ON r.serial_no = l.equipment_serial_no
""")
_key = " + ".join(f"coalesce({c}, 0)::BIGINT * {unit}" for c, unit in FX.WHATIF_FEATURES.items())
O.add_cte("whatif_w", "SELECT *, " + ", ".join(f"1e0 + (ck * {m}) % 97 AS w{i}" for i, m in enumerate(FX.PRIMARY_MULTIPLIERS)) +
          f" FROM (SELECT *, {_key} AS ck FROM whatif_adjusted WHERE found)")
O.add_cte("whatif_scored", _classes_sql("whatif_w"))
O.add_cte("whatif_components", _components_select_sql(source="whatif_scored"))

RESPONSE_SQL = O.with_ctes(f"""
SELECT r.request_id, r.serial_no, r.found, CASE WHEN NOT r.found THEN 'Motor ' || r.serial_no || ' not found' END AS error,
       p.* EXCLUDE (answered) REPLACE ({', '.join(f'CAST(p.{c} AS VARCHAR) AS {c}' for c in _AS_TEXT)}) FROM whatif_adjusted r LEFT JOIN
  (SELECT request_id AS answered, {_METADATA_SQL}{_prediction_columns_sql()} FROM whatif_components) p ON p.answered = r.request_id""",
                           "whatif_adjusted", "whatif_components")


def _flat(answers: DataFrame) -> DataFrame:
    flat = answers.select("request_id", "serial_no", "found", "error", *[F.col("metadata")[c].alias(c) for c in _METADATA], *_flat_prediction())
    return flat.withColumns({c: F.col(c).cast("string") for c in _AS_TEXT})


@register("d03_checklist_response", RESPONSE_SQL)
def d03_response(spark, sf_dir):
    """Whole answers (attributes, prediction, error) to requests with any number of codes.
    They are written as a sink would and flattened from there: answering and flattening in
    one pass took nearly twice the CPU time."""
    answers = RS.respond(FX.checklist_lists(spark, sf_dir), latest(spark, sf_dir), FX.with_feature_scores, AS_OF)
    return _flat(IO.read_table_path(spark, IO.write_table(answers, IO.shared_path(spark, "responses"))))


@register("d03_checklist_response_stream", RESPONSE_SQL)
def d03_response_stream(spark, sf_dir):
    """The same answers from a stream of request files, a micro-batch for each file, over a
    published set of latest records."""
    source = IO.write_table(FX.checklist_lists(spark, sf_dir).repartition(REQUEST_FILES, "request_id"), IO.shared_path(spark, "response-requests"))
    snapshots = Manifest(IO.shared_path(spark, "response-sets"))
    snapshots.publish(spark, {"latest": lambda path: IO.write_table(latest(spark, sf_dir), path)})
    sink = IO.shared_path(spark, "responses")
    query = RS.start_response_stream(spark, source, snapshots, lambda *_: FX.with_feature_scores, sink,
                                     IO.shared_path(spark, "response-checkpoint"), AS_OF, files_per_batch=1)
    query.awaitTermination()
    return _flat(spark.read.parquet(sink))
