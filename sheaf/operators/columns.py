"""Column views: cells, and summaries of all operators, as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.dates import duration_seconds, hours_minutes
from sheaf.operators.stored import settled

#: Properties that Org makes, which have no summary.
SPECIAL = {"ITEM": "title", "TODO": "todo", "PRIORITY": "priority", "LEVEL": "level"}
SPECIAL_TEXT = ("TAGS", "ALLTAGS", "CLOSED", "SCHEDULED", "DEADLINE")
NUMERIC = {"+": F.sum, "$": F.sum, "min": F.min, "max": F.max, "mean": F.avg}
DURATION = {":": F.sum, ":min": F.min, ":max": F.max, ":mean": F.avg}
BOXES = ("X", "X/", "X%")
#: Operators that are known and have no meaning without a clock.
UNSUPPORTED = ("@min", "@max", "@mean")


def _at(key: str) -> Column:
    return F.try_element_at("properties", F.lit(key))


def cell(sections: DataFrame, key: str, inherit: bool = True) -> tuple[Column, Column]:
    """A column's value of a headline and where it is from: special, local, inherited or missing."""
    name = key.upper()
    if name in SPECIAL and SPECIAL[name] in sections.columns:
        return F.col(SPECIAL[name]).cast("string"), F.lit("special")
    if name in SPECIAL_TEXT:
        return _at(name), F.lit("special")
    own, above = _at(name), _at(f"inherited:{name}") if inherit else F.lit(None).cast("string")
    return F.coalesce(own, above), F.when(own.isNotNull(), "local").when(above.isNotNull(), "inherited").otherwise("missing")


def number_text(value: Column, pattern: str | None = None) -> Column:
    """A number as text: ``%.Nf`` as it says; else without a fraction if it has none, else six digits without zeros at the end."""
    if pattern and pattern.startswith("%.") and pattern.endswith("f") and pattern[2:-1].isdigit():
        return F.format_string(pattern, value)
    short = F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    return F.when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(short)


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def _is_done(c: Column) -> Column:
    """Whether a cell counts as checked: [X], [100%] or [n/n]."""
    done, total = (F.regexp_extract(c, r"^\[\s*(\d+)\s*/\s*(\d+)\s*\]$", i).try_cast("long") for i in (1, 2))
    return F.trim(c).isin("[X]", "[100%]") | F.coalesce((done == total) & (total > 0), F.lit(False))


def _bounds(c: Column) -> tuple[Column, Column]:
    """Mean and variance of an estimate, a number or a range of two."""
    low = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)\s*(?:-\s*(\d+(?:\.\d+)?)\s*)?$", 1).try_cast("double")
    high = F.coalesce(F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*$", 2).try_cast("double"), low)
    return (low + high) / 2, F.pow((high - low) / 2, F.lit(2))


def _aggregate(op: str, pattern: str | None) -> tuple[Column, Column, Column]:
    """Over a parent's inputs (column ``given``): the summary, how many inputs it could read, and its status."""
    given = F.col("given")
    if op in NUMERIC:
        n = F.count(_number(given))
        out = number_text(NUMERIC[op](_number(given)).cast("double"), "%.2f" if op == "$" else pattern)
    elif op in DURATION:
        n = F.count(duration_seconds(given))
        out = hours_minutes(F.round(DURATION[op](duration_seconds(given))).cast("long"))
    elif op in BOXES:
        n, done = F.count(given), F.count_if(_is_done(given))
        percent = F.floor((done * 100 + F.floor(n / 2)) / F.greatest(n, F.lit(1)))
        out = {"X": F.when(done == n, "[X]").when(done > 0, "[-]").otherwise("[ ]"), "X/": F.format_string("[%d/%d]", done, n), "X%": F.format_string("[%d%%]", percent)}[op]
    elif op == "est+":
        mean, variance = _bounds(given)
        n, middle, off = F.count(mean), F.sum(mean), F.sqrt(F.sum(variance))
        out = F.format_string("%.0f-%.0f", F.bround(middle - off), F.bround(middle + off))
    else:
        n, out = F.lit(0), F.lit(None).cast("string")
        return out, n.cast("long"), F.lit("unsupported")
    return F.when(n > 0, out), n, F.when(n > 0, "computed").otherwise("unparsedInputs")


def summaries(sections: DataFrame, key: str, op: str, pattern: str | None = None, inherit: bool = False) -> DataFrame:
    """(section_id, level, value, summary, inputs, status) of a column with a summary, for each headline.

    A parent's inputs are its children's summaries, or their own cells where they
    have none; a headline without an input has the status noInputs, a special
    column ignoredSpecialProperty.  Levels are worked out once each, from the
    lowest up, and stored, so a level's plan holds nothing of those below it.
    """
    value, _ = cell(sections, key, inherit)
    rows = sections.select("section_id", "parent_id", "level", value.alias("value"))
    none = lambda status: [F.lit(None).cast("string").alias("summary"), F.lit(0).cast("long").alias("inputs"), F.lit(status).alias("status")]
    if key.upper() in SPECIAL or key.upper() in SPECIAL_TEXT:
        return rows.select("section_id", "level", "value", *none("ignoredSpecialProperty"))
    rows = settled(rows)
    summary, inputs, status = _aggregate(op, pattern)
    levels = [r[0] for r in rows.select("level").distinct().collect()]  # a document has few levels
    done = None
    below = None
    for level in sorted(levels, reverse=True):
        own = rows.where(F.col("level") == level)
        if below is None:
            now = own.select("*", *none("noInputs"))
        else:
            given = below.withColumn("given", F.coalesce("summary", "value")).where("given is not null and parent_id is not null")
            got = given.groupBy(F.col("parent_id").alias("section_id")).agg(summary.alias("summary"), inputs.cast("long").alias("inputs"), status.alias("status"))
            now = own.join(got, "section_id", "left").select("section_id", "parent_id", "level", "value", "summary", F.coalesce("inputs", F.lit(0)).alias("inputs"), F.coalesce("status", F.lit("noInputs")).alias("status"))
        now = settled(now)
        done = now if done is None else done.union(now)
        # Children may lie more than one level down.
        below = now if below is None else now.unionByName(below.where(~F.col("level").isin(level)))
    return (rows.select("*", *none("noInputs")) if done is None else done).select("section_id", "level", "value", "summary", "inputs", "status")


def clock_table_properties(table: DataFrame, sections: DataFrame, keys: list[str], inherit: bool = False) -> DataFrame:
    """A clock table with a column for each property."""
    cells = sections.select("section_id", *(cell(sections, k, inherit)[0].alias(k) for k in keys))
    return table.join(cells, "section_id", "left")
