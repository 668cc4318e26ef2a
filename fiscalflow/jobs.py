"""Batch entry points (``spark-submit -m``-style): the monthly report job and the
dashboard refresh job.

    python -m fiscalflow.jobs report --model <dir> --out <dir> [--as-of YYYY-MM-DD]
    python -m fiscalflow.jobs refresh --model <dir>
    python -m fiscalflow.jobs report --jdbc --key-range tasks=1:90000000:400 ... --out <dir>

``--model`` is a folder with one parquet dataset per model table; ``--tpch`` reads
the driver's TPC-H-like tables instead and maps them; ``--jdbc`` reads the database
named by the environment (DB_HOST, DB_PORT, DB_NAME, DB_USER, DB_PASSWORD), every large
table split by a ``--key-range``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

from fiscalflow.operators.dashboard import Dashboard
from fiscalflow.operators.export import export_report
from fiscalflow.operators.report import report_last_month
from fiscalflow.session import build_session, size_shuffles
from fiscalflow.sources.jdbc import connection_from_env, parse_key_range, read_jdbc_model
from fiscalflow.sources.parquet import read_model
from fiscalflow.sources.tpch import model_from_tpch


def _model(spark, args):
    if args.jdbc:
        ranges = dict(parse_key_range(x) for x in args.key_range)
        return read_jdbc_model(spark, key_ranges=ranges, **connection_from_env(os.environ))
    if args.shuffle_partitions is None and not spark.sparkContext.master.startswith("local"):
        size_shuffles(spark, args.tpch or args.model)
    return model_from_tpch(spark, args.tpch) if args.tpch else read_model(spark, args.model)


def run_report(spark, args) -> str | None:
    as_of = dt.date.fromisoformat(args.as_of) if args.as_of else dt.date.today()
    report = report_last_month(_model(spark, args), as_of, materialize_keys=True)
    path = export_report(report, args.out, as_of, fmt=args.format,
                         titles=getattr(args, "titles", False))
    print(f"report written to {path}" if path else "no documents posted in the period")
    return path


def run_refresh(spark, args) -> None:
    dash = Dashboard.refresh(_model(spark, args), name=args.name)
    print(f"dashboard fact stored: {dash.fact.inputFiles()[:1]} ...")


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="fiscalflow.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    for name in ("report", "refresh"):
        p = sub.add_parser(name)
        src = p.add_mutually_exclusive_group(required=True)
        src.add_argument("--model")
        src.add_argument("--tpch")
        src.add_argument("--jdbc", action="store_true")
        p.add_argument("--key-range", action="append", default=[], metavar="TABLE=LOWER:UPPER:PARTITIONS")
        p.add_argument("--master", default=None)
        p.add_argument("--profile", default=None, choices=["local", "cluster"])
        p.add_argument("--shuffle-partitions", type=int, default=None)
        if name == "report":
            p.add_argument("--out", required=True)
            p.add_argument("--as-of", default=None)
            p.add_argument("--format", default="csv", choices=["csv", "parquet"])
            p.add_argument("--titles", action="store_true",
                           help="write the original column titles as the header")
        else:
            p.add_argument("--name", default="dashboard_fact")
    args = ap.parse_args(argv)
    spark = build_session(
        args.master, app_name=f"fiscalflow-{args.job}", profile=args.profile,
        shuffle_partitions=args.shuffle_partitions,
    )
    try:
        if args.job == "report":
            run_report(spark, args)
        else:
            run_refresh(spark, args)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
