"""Command line: run the application's jobs on Spark.

  python -m motorlytics features  (--csv PATH | --tables DIR) --out DIR
  python -m motorlytics lifecycle (--csv PATH | --tables DIR) --out DIR [--cv K]
  python -m motorlytics dashboard (--csv PATH | --tables DIR)
  python -m motorlytics fleet     (--csv PATH | --tables DIR) [--out DIR]

Input is a requisition CSV (scanned with the explicit schema) or a folder of
the driver tables (requisitions derived from orders, customer and nation).
Tables go to --out (a shared folder). Only one-row records are printed
(dashboard, fleet summary), as JSON.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession


def _requisitions(spark: SparkSession, args) -> DataFrame:
    if args.csv:
        from motorlytics.sources.io import read_requisitions_csv
        return read_requisitions_csv(spark, args.csv)
    from motorlytics.sources.fixtures import requisitions
    return requisitions(spark, args.tables)


def _print_row(df: DataFrame) -> None:
    """Print a one-row result as JSON."""
    print(df.toJSON().first())


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="motorlytics")
    p.add_argument("command", choices=["features", "lifecycle", "dashboard", "fleet"])
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv")
    src.add_argument("--tables")
    p.add_argument("--out")
    p.add_argument("--cv", type=int, default=0)
    p.add_argument("--master", default=None)
    args = p.parse_args(argv)

    from motorlytics.session import get_spark
    spark = get_spark(args.master)
    req = _requisitions(spark, args)

    if args.command == "features":
        if not args.out:
            p.error("--out is required")
        from motorlytics.operators.features import engineer
        from motorlytics.sources import io as IO
        eng, enc = engineer(req)
        IO.write_table(eng, f"{args.out.rstrip('/')}/engineered")
        IO.save_encoders(enc, f"{args.out.rstrip('/')}/encoders")
    elif args.command == "lifecycle":
        if not args.out:
            p.error("--out is required")
        from motorlytics.plans.lifecycle import run_batch_lifecycle
        paths = run_batch_lifecycle(spark, req, args.out, cv_folds=args.cv)
        print(json.dumps(paths))
    elif args.command == "dashboard":
        from motorlytics.operators.dashboards import combined_dashboard
        _print_row(combined_dashboard(req))
    elif args.command == "fleet":
        # rule-based scores when no model is given: latest record per motor
        from pyspark.sql import functions as F
        from motorlytics.operators import scoring as SC
        from motorlytics.operators.features import engineer
        eng, _ = engineer(req)
        latest = SC.latest_records(eng.drop("updated_at"), position_col="repair_count")
        fleet = latest.withColumns({"risk_class": F.col("risk_category"), "predicted_risk": F.col("risk_label")})
        if args.out:
            from motorlytics.sources.io import write_batch_predictions
            write_batch_predictions(fleet, f"{args.out.rstrip('/')}/batch_predictions")
        _print_row(SC.fleet_summary_record(spark, fleet))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
