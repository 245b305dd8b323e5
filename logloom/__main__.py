"""Command line: lines from standard input to templates on standard output."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logloom.config import TemplaterConfig, grouper_name
from logloom.plans import api, render
from logloom.sources import body_lines, parse_lines


def grouper(name: str) -> str:
    try:
        return grouper_name(name)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None


def count(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise argparse.ArgumentTypeError(f"invalid samples value: {text}")
    return int(text)


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="logloom", description="Templates of log lines.", allow_abbrev=False)
    p.add_argument("--json", action="store_true", help="input is NDJSON")
    p.add_argument("--grouper", type=grouper, default=TemplaterConfig.grouper)
    p.add_argument("--samples", type=count, default=TemplaterConfig.sample_cap)
    p.add_argument("--format", choices=("text", "json"), default="text")
    p.add_argument("--stats", action="store_true", help="totals to standard error")
    return p.parse_args(args)


def main(args: list[str] | None = None) -> int:
    a = arguments(args)
    try:
        body = sys.stdin.buffer.read().decode("utf-8")
    except (OSError, UnicodeDecodeError):
        print("failed to read stdin", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("logloom").getOrCreate()
    lines = parse_lines(body_lines(spark.createDataFrame([(0, body)], "window_id long, body string")), "ndjson" if a.json else "text")
    groups = api.template_logs(lines, TemplaterConfig(grouper=a.grouper, sample_cap=a.samples)).persist()
    if a.format == "json":
        found = render.to_json(groups, pretty=True).first()
        print(found["json"] if found else '{"groups":[],"original_count":0,"template_count":0,"line_compression":0.0}')
    else:
        found = render.render(groups).first()
        print(found["text"] if found else "")
    if a.stats:
        n, m = groups.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
        print(f"{n} lines -> {m} templates ({n / m if m else 0:.1f}x)", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
