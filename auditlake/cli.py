"""Commands: `scan` audits the repository alone, `audit` adds security and database modules. Exit codes: 0, 1 (threshold reached), 2 (failure)."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path


def timeout(most: int):
    def parse(text: str) -> int:
        value = int(text) if text.isdigit() else 0
        if not 1 <= value <= most:
            raise argparse.ArgumentTypeError(f"must be an integer from 1 to {most}")
        return value

    return parse


def schemas(values: list[str] | None) -> tuple[str, ...]:
    """Trimmed and distinct, in order; the default without any."""
    return tuple(dict.fromkeys(v.strip() for v in values or [] if v.strip())) or ("public",)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="auditlake")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("scan", "audit"):
        p = commands.add_parser(name)
        p.add_argument("path", nargs="?", default=".")
        p.add_argument("--format", choices=("text", "json", "sarif"))
        p.add_argument("--json", action="store_true")
        p.add_argument("--output", help="a file in a folder that all executors share: JSON and SARIF findings are written by them")
        p.add_argument("--fail-on", choices=("info", "low", "medium", "high", "critical", "none"), default="high")
        p.add_argument("--exclude", action="append", default=[])
        p.add_argument("--changed", action="store_true")
        p.add_argument("--base")
        p.add_argument("--baseline")
        p.add_argument("--run-checks", action="store_true")
        p.add_argument("--timeout", type=timeout(3_600_000), default=120_000)
        if name == "audit":
            p.add_argument("--with-database", action="store_true")
            p.add_argument("--database-schema", action="append")
            p.add_argument("--database-timeout", type=timeout(3_600_000), default=10_000)
    return out


def connect(at: str):
    """A DB-API connection through whichever PostgreSQL driver is installed."""
    import importlib

    for driver in ("psycopg", "psycopg2"):
        try:
            return importlib.import_module(driver).connect(at)
        except ModuleNotFoundError as missing:
            if missing.name != driver:
                raise
    raise RuntimeError("no PostgreSQL driver is installed")


def main(argv: list[str] | None = None, connect=connect) -> int:
    args = parser().parse_args(argv)
    if args.json and args.format not in (None, "json"):
        parser().error("--json and another --format exclude each other")
    if args.output and (args.format or "text") == "text" and not args.json:
        parser().error("--output needs --format json or sarif")
    if args.base is not None and (not args.changed or not args.base.strip()):
        parser().error("--base needs --changed and must not be blank")
    from pyspark.sql import SparkSession

    from auditlake.plans import engine, export, reports
    from auditlake.sources.files import InventoryError, baseline
    from auditlake.sources.git import GitError

    spark = SparkSession.builder.appName("auditlake").getOrCreate()
    wide = args.command == "audit"
    request = engine.Request(str(Path(args.path).resolve()), tuple(args.exclude), args.changed, args.base, wide, wide, args.run_checks, wide and args.with_database, args.timeout,
                             schemas(getattr(args, "database_schema", None)), getattr(args, "database_timeout", 10_000))
    try:
        old = baseline(spark, args.baseline) if args.baseline else None
        result = engine.scan(spark, request, load=engine.catalog_loader(connect, None, os.environ))
        result = result.with_baseline(old) if old is not None else result
        kind = "json" if args.json else args.format or "text"
        color = sys.stdout.isatty() and "NO_COLOR" not in os.environ
        if args.output and kind != "text":
            {"json": export.write_json, "sarif": export.write_sarif}[kind](result, args.output)
            return result.exit_code(args.fail_on)
        sys.stdout.write({"json": reports.to_json, "sarif": reports.to_sarif}[kind](result) if kind != "text" else reports.to_text(result, color))
        return result.exit_code(args.fail_on)
    except (InventoryError, GitError, ValueError) as e:
        print(f"auditlake: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
