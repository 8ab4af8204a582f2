"""Property schemas: contracts that a drawer names by its PROPERTY_SCHEMA, and what of the drawer breaks them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "PROPERTY_SCHEMA"


@dataclass
class Field:
    """A property of a schema; ``rule`` is ``any``, ``nonEmpty`` or ``oneOf`` the ``values``."""

    key: str
    required: bool = False
    rule: str = "any"
    values: list[str] = field(default_factory=list)


@dataclass
class Schema:
    id: str
    fields: list[Field]
    aliases: list[str] = field(default_factory=list)
    allow_unknown: bool = True


def from_json(entries: list[dict]) -> list[Schema]:
    """Schemas of parsed JSON: id, aliases, allowUnknownProperties, fields (key, required, rule or oneOf)."""
    out = []
    for s in entries:
        fields = [Field(f["key"], bool(f.get("required")), "oneOf" if "oneOf" in f else f.get("rule", "any"), list(f.get("oneOf", []))) for f in s.get("fields", [])]
        if bad := [f.rule for f in fields if f.rule not in ("any", "nonEmpty", "oneOf")]:
            raise ValueError(f"no rule {bad[0]!r}")
        out.append(Schema(s["id"], fields, list(s.get("aliases", [])), bool(s.get("allowUnknownProperties", True))))
    return out


def _tables(spark: SparkSession, schemas: list[Schema]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schema, name), the first schema of a name; (schema, id, unknown, known); (schema, key, required, rule, values)."""
    names: dict[str, int] = {}
    for i, s in enumerate(schemas):
        for name in (x.strip() for x in [s.id, *s.aliases]):
            if name:
                names.setdefault(name, i)
    one = spark.createDataFrame([(n, i) for n, i in names.items()], "name string, schema int")
    two = spark.createDataFrame([(i, s.id, s.allow_unknown, [f.key.upper() for f in s.fields]) for i, s in enumerate(schemas)], "schema int, contract string, unknown boolean, known array<string>")
    rows = [(i, f.key, f.required, f.rule, f.values) for i, s in enumerate(schemas) for f in s.fields]
    return one, two, spark.createDataFrame(rows, "schema int, key string, required boolean, rule string, values array<string>")


def applications(elements: DataFrame, schemas: list[Schema]) -> DataFrame:
    """A row for each drawer that names a schema: the reference, its kind, the contract it leads to, and the properties of the drawer.

    The last PROPERTY_SCHEMA of a drawer counts.  A reference leads to the first
    schema whose id or alias is its text or what is left of it: the target of a
    link to a file, or the argument of a macro.
    """
    p = lambda key: F.try_element_at("properties", F.lit(key))
    own = F.struct("range_start", "line", p("key").alias("key"), F.upper(p("key")).alias("name"), F.coalesce(p("value"), F.lit("")).alias("value"))
    rows = elements.where("kind = 'node-property'").groupBy("source_file", F.col("parent_id").alias("drawer_id")).agg(F.array_sort(F.collect_list(own)).alias("own"))
    rows = rows.withColumn("at", F.try_element_at(F.filter("own", lambda x: x["name"] == NAMES), F.lit(-1))).where("at is not null")
    raw = F.trim("at.value")
    link = F.trim(F.regexp_extract(raw, r"^\[\[(.*?)(?:\]\[.*)?\]\]$", 1))
    argument = F.trim(F.regexp_extract(raw, r"^\{\{\{[^(]*\((.*)\)[^)]*\}\}\}$", 1))
    path = F.substring_index(F.substring_index(raw, "#", 1), "?", 1)
    linked, called = F.startswith(link, F.lit("file:")), argument != ""
    kind = F.when(raw == "", "empty").when(linked, "orgFileLink").when(called, "macro").when(F.regexp(path, F.lit(r"^file:|/|\.(json|toml|yaml|yml)$")), "file").otherwise("contractId")
    normal = F.when(linked, link).when(called, argument).otherwise(raw)
    one, two, _ = _tables(elements.sparkSession, schemas)
    by = lambda c, n: (one.select(F.col("name").alias(c), F.col("schema").alias(n)), c, "left")
    found = rows.withColumns({"reference": raw, "normalized": normal, "reference_kind": kind}).join(*by("reference", "s1")).join(*by("normalized", "s2"))
    return found.withColumn("schema", F.least("s1", "s2")).drop("s1", "s2").join(two, "schema", "left")


def findings(elements: DataFrame, schemas: list[Schema]) -> DataFrame:
    """(source_file, line, range_start, finding, property, actual, contract): what is wrong with the drawers that name schemas.

    emptyReference, unresolvedReference, missingRequiredProperty, emptyValue,
    disallowedValue; unknownProperty where the schema takes no others, for
    keys that are neither its own, nor PROPERTY_SCHEMA, nor lists of allowed values.
    """
    rows = applications(elements, schemas)
    out = lambda df, at, finding, key, actual: df.select("source_file", at["line"].alias("line"), at["range_start"].alias("range_start"), finding.alias("finding"), key.alias("property"), actual.alias("actual"), "contract")
    at = F.col("at")
    lost = out(rows.where("schema is null"), at, F.when(F.col("reference_kind") == "empty", "emptyReference").otherwise("unresolvedReference"), F.lit(NAMES), F.col("reference"))
    each = rows.where("schema is not null").join(_tables(elements.sparkSession, schemas)[2], "schema")
    held = F.try_element_at(F.filter("own", lambda x: x["name"] == F.upper("key")), F.lit(-1))
    each = each.withColumn("held", held)
    value = F.col("held.value")
    finding = (
        F.when(F.col("held").isNull() & F.col("required"), "missingRequiredProperty")
        .when((F.col("rule") == "nonEmpty") & (F.trim(value) == ""), "emptyValue")
        .when((F.col("rule") == "oneOf") & ~F.array_contains("values", value), "disallowedValue")
    )
    wrong = out(each.withColumn("finding", finding).where("finding is not null"), F.coalesce("held", "at"), F.col("finding"), F.coalesce("held.key", "key"), value)
    strange = F.filter("own", lambda x: (x["name"] != NAMES) & ~F.endswith(x["name"], F.lit("_ALL")) & ~F.array_contains("known", x["name"]))
    others = rows.where("schema is not null and not unknown").withColumn("other", F.explode(strange))
    return lost.union(wrong).union(out(others, F.col("other"), F.lit("unknownProperty"), F.col("other.key"), F.col("other.value")))
