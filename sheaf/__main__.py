"""Command line: python -m sheaf COMMAND PATH [options].  PATH is a folder or a file, or - for standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import agenda_views, lint, lint_sdd, plans, records
from sheaf.sources import org, packets


def documents(spark: SparkSession, path: str) -> DataFrame:
    if path == "-":
        return spark.createDataFrame([("stdin", sys.stdin.read())], "source_file string, text string")
    return org.read_folder(spark, path) if not path.endswith((".org", ".org_archive")) else spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def lines(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The output of a command as one column ``out``, in order."""
    e = org.parse(documents(spark, args.path))
    if args.command == "elements":
        return packets.index_json(e).orderBy("source_file", "id").select(F.col("json").alias("out"))
    if args.command == "lint":
        return lint.rendered(lint.findings(e), args.form).orderBy("source_file", "line", "code", "out").select("out")
    if args.command == "sdd":
        return lint_sdd.status(e).orderBy("source_file", "kind", "status").select(F.concat_ws(" ", "source_file", "kind", F.coalesce("status", F.lit("-")), "n").alias("out"))
    if args.command == "sql":
        return org.sql(org.org_elements(e), args.text).select(F.to_json(F.struct("*")).alias("out"))
    if args.command == "search":
        return plans.search_packet(e, args.text).select(F.concat_ws(" ", "source_file", "json").alias("out"))
    found = agenda_views.search(records.sections(e), args.text)
    return found.orderBy("source_file", "line").select(F.format_string("%s:%d: %s", "source_file", "line", "title").alias("out"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sheaf", description=__doc__)
    parser.add_argument("command", choices=["elements", "lint", "sdd", "sql", "search", "headlines"])
    parser.add_argument("path")
    parser.add_argument("text", nargs="?", default="", help="an SQL query over org_elements, or what to search for")
    parser.add_argument("--form", choices=["text", "compact", "json"], default="text", help="of findings")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    for row in lines(spark, args).toLocalIterator():
        print(row["out"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
