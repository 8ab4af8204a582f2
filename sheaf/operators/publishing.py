"""Publishing projects: what each document becomes, what it depends on, and the map of the site.  Nothing is published."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators.export_graph import dependencies as export_dependencies
from sheaf.operators.export_graph import keywords


@dataclass
class Project:
    name: str
    root: str
    directory: str


def documents(elements: DataFrame) -> DataFrame:
    """(source_file, output_file, title) of every document: the last EXPORT_FILE_NAME, else the path as .html; the first TITLE, null if empty."""
    of = lambda key, by: by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.col("range_start")))
    set_ = keywords(elements).where(F.upper("key").isin("EXPORT_FILE_NAME", "TITLE")).withColumn("key", F.upper("key"))
    set_ = set_.groupBy("source_file").agg(of("EXPORT_FILE_NAME", F.max_by).alias("_file"), F.trim(of("TITLE", F.min_by)).alias("_title"))
    rows = elements.where("kind = 'org-data'").select("source_file").join(set_, "source_file", "left")
    html = F.concat(F.regexp_replace("source_file", r"\.org$", ""), F.lit(".html"))
    return rows.select("source_file", F.coalesce("_file", html).alias("output_file"), F.when(F.col("_title") != "", F.col("_title")).alias("title"))


def dependencies(elements: DataFrame, project: Project) -> DataFrame:
    """(source_file, kind, target): projectRoot of every document, and its includes, setup files, bibliographies and macros."""
    kinds = F.create_map(*(F.lit(x) for kv in (("includes", "include"), ("usesSetupFile", "setupFile"), ("usesBibliography", "bibliography")) for x in kv))
    files = export_dependencies(elements).select(F.col("src").alias("source_file"), kinds[F.col("kind")].alias("kind"), F.col("dst").alias("target"))
    macros = keywords(elements, "MACRO").select("source_file", F.lit("macro").alias("kind"), F.regexp_extract("value", r"^\s*(\S+)", 1).alias("target")).where("target <> ''")
    roots = elements.where("kind = 'org-data'").select("source_file", F.lit("projectRoot").alias("kind"), F.lit(project.root).alias("target"))
    return roots.union(files).union(macros)


def sitemap(elements: DataFrame, project: Project) -> DataFrame:
    """(sitemap, source_file, output_file, title): the entries of the map of the site; a document without a title goes by its path."""
    folder = project.directory.rstrip("/")
    out = f"{folder}/sitemap.org" if folder else "sitemap.org"
    return documents(elements).select(F.lit(out).alias("sitemap"), "source_file", "output_file", F.coalesce("title", "source_file").alias("title"))


def warnings(elements: DataFrame) -> DataFrame:
    """(kind): emptyProject if there is no document."""
    return elements.where("kind = 'org-data'").agg(F.count("*").alias("n")).where("n = 0").select(F.lit("emptyProject").alias("kind"))
