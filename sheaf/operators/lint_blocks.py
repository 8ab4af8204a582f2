"""Validation rules on source blocks and table formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators import records

#: Left sides that a formula may have: a cell or row, a named or numbered column, the first or last column.
LHS = r"^(@[-+I<>0-9.$@]+|\$([A-Za-z0-9_]+|[<>]+))$"


def _p(key: str) -> Column:
    return F.try_element_at("properties", F.lit(key))


def _finding(rows: DataFrame, code: str, message: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit("warning").alias("severity"), "source_file", "line", "range_start", message.alias("message"))


def _header(name: str) -> Column:
    """An argument of a source block's own line: null if it isn't there, '' if it has no value."""
    return F.trim(F.trim(F.trim(_p(f"header:{name}")), F.lit('"')))


def _blocks(e: DataFrame) -> DataFrame:
    return e.where("kind = 'src-block'")


def missing_references(e: DataFrame) -> DataFrame:
    """ORG021: a call, a noweb reference or a variable that names no block of its document."""
    lines = e.where(F.col("kind").isin("babel-call", "inline-babel-call", "src-block")).select("source_file", "range_start", "line").dropDuplicates(["source_file", "range_start"])
    calls = records.source_references(e).where("not resolved").select("source_file", "range_start", "name").join(lines, ["source_file", "range_start"])
    named = e.where("affiliated_name is not null").select("source_file", F.lower(F.trim("affiliated_name")).alias("name")).distinct()
    variables = _blocks(e).withColumn("name", F.explode(F.regexp_extract_all(_p("header:var"), F.lit(r"[\w-]+=([A-Za-z][\w-]*)(?=\s|$)"), F.lit(1)))).withColumn("name", F.lower("name"))
    rows = calls.select("source_file", "line", "range_start", "name").union(variables.join(named, ["source_file", "name"], "left_anti").select("source_file", "line", "range_start", "name"))
    return _finding(rows, "ORG021", F.concat(F.lit("no source block of this name: "), "name"))


def eval_headers(e: DataFrame) -> DataFrame:
    """ORG022: an explicit :eval of yes or query; none given means yes."""
    value = F.lower(_header("eval"))
    return _finding(_blocks(e).where(value.isin("", "yes", "query")), "ORG022", F.concat(F.lit("review :eval "), value))


def bad_tangles(e: DataFrame) -> DataFrame:
    """ORG023: a tangle target that is empty."""
    return _finding(_blocks(e).where(_header("tangle") == ""), "ORG023", F.lit("empty tangle target"))


def _runs() -> Column:
    return ~F.coalesce(F.lower(_header("eval")), F.lit("yes")).isin("no", "never")


def sessions(e: DataFrame) -> DataFrame:
    """ORG041: a block that may run in a session."""
    return _finding(_blocks(e).where(_header("session").isNotNull() & (F.lower(_header("session")) != "none") & _runs()), "ORG041", F.concat(F.lit("uses session "), _header("session")))


def caches(e: DataFrame) -> DataFrame:
    """ORG042: a block that may run and caches its result."""
    return _finding(_blocks(e).where(F.lower(_header("cache")).isin("yes", "t", "true") & _runs()), "ORG042", F.lit("caches its result"))


def result_files(e: DataFrame) -> DataFrame:
    """ORG043: a result that is a file, without the file's name."""
    return _finding(_blocks(e).where(F.array_contains(F.split(F.lower(_header("results")), r"\s+"), "file") & _header("file").isNull()), "ORG043", F.lit(":results file without :file"))


def _assignments(e: DataFrame) -> DataFrame:
    """Assignments of formula lines, one row each: raw, lhs, rhs; ``formula`` is the number of the line."""
    rows = e.where("kind = 'table'").where(_p("formulas").isNotNull())
    rows = rows.select("source_file", "line", "range_start", "properties", "source_raw", F.posexplode(F.split(_p("formulas"), "\n")).alias("formula", "all"))
    rows = rows.withColumn("raw", F.explode(F.split("all", "::"))).withColumn("raw", F.trim("raw")).where("raw <> ''")
    whole = F.regexp_replace("raw", r";[^;()]*$", "")
    return rows.withColumns({"lhs": F.trim(F.substring_index("raw", "=", 1)), "rhs": F.when(F.contains("raw", F.lit("=")), F.trim(F.regexp_extract(whole, r"^[^=]*=(.*)$", 1)))})


def malformed_formulas(e: DataFrame) -> DataFrame:
    """ORG024: an assignment without =, a left side that is no place of a table, an empty right side, or remote( without its end; each message once a line."""
    opened = F.length(F.regexp_replace("raw", r"[^(]", "")) > F.length(F.regexp_replace("raw", r"[^)]", ""))
    reasons = F.array_compact(F.array(
        F.when(F.col("rhs").isNull(), F.concat(F.lit("no = in "), "raw")),
        F.when(F.col("rhs").isNotNull() & (F.col("lhs") == ""), F.lit("empty left side")),
        F.when(F.col("rhs").isNotNull() & (F.col("lhs") != "") & ~F.regexp("lhs", F.lit(LHS)), F.concat(F.lit("no place of a table: "), "lhs")),
        F.when(F.col("rhs") == "", F.concat(F.lit("empty right side of "), "lhs")),
        F.when(F.col("rhs").isNotNull() & F.contains("raw", F.lit("remote(")) & opened, F.lit("remote( is not closed")),
    ))
    rows = _assignments(e).withColumn("message", F.explode(reasons)).dropDuplicates(["source_file", "range_start", "formula", "message"])
    return _finding(rows, "ORG024", F.col("message"))


def duplicate_formulas(e: DataFrame) -> DataFrame:
    """ORG025: one target assigned twice in one formula line."""
    rows = _assignments(e).where(F.contains("raw", F.lit("=")) & F.regexp("lhs", F.lit(LHS)))
    many = rows.groupBy("source_file", "line", "range_start", "formula", "lhs").count().where("count > 1")
    return _finding(many, "ORG025", F.concat(F.lit("assigned twice: "), "lhs"))


def formula_bounds(e: DataFrame) -> DataFrame:
    """ORG026: a row or column number that the table doesn't have; each reference once a line."""
    local = F.regexp_replace("raw", r"remote\([^)]*\)", "")
    ref = F.explode(F.regexp_extract_all(local, F.lit(r"([@$][A-Za-z0-9$@#.<>_+-]*)"), F.lit(1)))
    rows = _assignments(e).withColumn("ref", ref).where(~F.contains("ref", F.lit("#"))).withColumn("end", F.explode(F.split("ref", r"\.\.")))
    number = lambda mark: F.regexp_extract("end", rf"{mark}(\d+)", 1).try_cast("int")
    row, column = F.when(F.regexp("end", F.lit(r"^[^@]*@\d")), number("@")), F.when(F.regexp("end", F.lit(r"^[^$]*\$\d")), number(r"\$"))
    rows = rows.withColumns({"row": row, "column": column})
    out = lambda n, size: F.col(n).isNotNull() & ((F.col(n) == 0) | (F.col(n) > size))
    # Rules between rows count as rows here.
    height, width = F.size(F.regexp_extract_all("source_raw", F.lit(r"(?m)^[ \t]*(\|)"), F.lit(1))), F.coalesce(_p("columns").cast("int"), F.lit(0))
    what = F.explode(F.array_compact(F.array(F.when(out("row", height), "row"), F.when(out("column", width), "column"))))
    found = rows.withColumn("what", what).dropDuplicates(["source_file", "range_start", "formula", "ref", "what"])
    return _finding(found, "ORG026", F.concat("what", F.lit(" out of bounds: "), "ref"))


RULES = {"ORG021": missing_references, "ORG022": eval_headers, "ORG023": bad_tangles, "ORG024": malformed_formulas, "ORG025": duplicate_formulas, "ORG026": formula_bounds, "ORG041": sessions, "ORG042": caches, "ORG043": result_files}
