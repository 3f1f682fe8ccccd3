"""The jobs from the command line, for ``spark-submit`` or ``python -m callharmony``.

    run    <source> --pages <page table or files> --table <path> [--lake <path>] [--rejected <path>] [--run-id <id>]
    run    <source> --landing <path> --table <path> ...       fetch first, then run
    stream <source> --pages <page files> --table <path> --checkpoint <path> [--lake <path>]
    audit  <source> --pages <page table or files>
    show   --table <path>
"""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from callharmony.operators import audit_summary, load_crosswalk
from callharmony.plans import audit, fetch_pages, run
from callharmony.session import build_session, fit_to
from callharmony.sinks import CallTable, preview
from callharmony.sources import SPECS, SourceSpec, read_array_files, read_page_files, read_page_table
from callharmony.streaming import run_stream


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="callharmony")
    parser.add_argument("command", choices=["run", "stream", "audit", "show"])
    parser.add_argument("source", nargs="?", choices=list(SPECS))
    parser.add_argument("--pages", help="landed pages")
    parser.add_argument("--landing", help="page table to fetch into")
    parser.add_argument("--layout", choices=["table", "files"], default="table")
    parser.add_argument("--table", help="the table of calls")
    parser.add_argument("--lake", help="base path for raw rows")
    parser.add_argument("--rejected", help="base path for rows that were refused or read in part, with the reasons")
    parser.add_argument("--checkpoint")
    parser.add_argument("--crosswalk", help="CSV files to use in place of the packaged dictionaries")
    parser.add_argument("--run-id", help="the run to read; for landed pages the last one, for a fetch the time now")
    parser.add_argument("--all-runs", action="store_true", help="read every landed run, to build the table anew")
    parser.add_argument("--page-size", type=int)
    parser.add_argument("--allow-incomplete", action="store_true")
    args = parser.parse_args(argv)
    needed = {
        "run": ["source", "table"],
        "stream": ["source", "pages", "table", "checkpoint"],
        "audit": ["source", "pages"],
        "show": ["table"],
    }[args.command]
    missing = [name for name in needed if getattr(args, name) is None]
    if missing or (args.command == "run" and (args.pages is None) == (args.landing is None)):
        parser.error(f"{args.command} needs {', '.join(needed)}" + " and pages or landing" * (args.command == "run"))
    return args


def landed_pages(spark: SparkSession, spec: SourceSpec, args: argparse.Namespace) -> DataFrame:
    if args.layout == "files" and not spec.paged:
        pages = read_array_files(spark, args.pages, spec.slug)
    elif args.layout == "files":
        pages = read_page_files(spark, args.pages, spec.slug)
    else:
        pages = read_page_table(spark, args.pages).where(F.col("dataset") == spec.slug)
    if args.all_runs or args.command == "audit" and args.run_id is None:
        return pages
    if args.run_id is None:
        args.run_id = pages.agg(F.max("run_id")).first()[0]
    return pages.where(F.col("run_id") == args.run_id)


def main(argv: list[str] | None = None) -> None:
    args = parse_args(argv)
    spark = build_session()
    if args.pages:
        fit_to(spark, args.pages)
    spec = SPECS.get(args.source)
    if spec and args.page_size:
        spec = replace(spec, page_size=args.page_size)
    if args.command == "show":
        preview(CallTable(spark, args.table).read())
    elif args.command == "audit":
        pages = landed_pages(spark, spec, args)
        audit_summary(audit(spec, pages), by=("dataset", "run_id")).show(truncate=False)
    elif args.command == "stream":
        calls = CallTable(spark, args.table)
        crosswalk = load_crosswalk(spark, args.crosswalk)
        run_stream(spec, args.pages, crosswalk, calls, args.checkpoint, args.lake, None, args.allow_incomplete)
    else:
        if args.landing:
            args.run_id = args.run_id or datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
            pages = fetch_pages(spark, spec, args.landing, args.run_id, allow_incomplete=args.allow_incomplete)
        else:
            pages = landed_pages(spark, spec, args)
        calls = CallTable(spark, args.table)
        crosswalk = load_crosswalk(spark, args.crosswalk)
        run_id = args.run_id or datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
        report = run(spec, pages, crosswalk, calls, args.lake, run_id, args.allow_incomplete, args.rejected)
        print(f"{report.records} records found. {report}")


if __name__ == "__main__":
    main()
