"""Import and export of a normative area as JSON lines, and report sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.sources.scratch import shared_folder

_CARD = "id string, source_id string, entity_type string, term string, description string, local_profile string, citations array<struct<locator:string,quote:string,start:int,end:int>>"
#: Record types of an area and their fields.
AREA = {
    "source": "id string, name string, text string",
    "profile": "id string, name string, parents array<string>, sources array<string>",
    "requirement": _CARD,
    "glossary": _CARD,
    "choice": "key string, active_entry_id string",
    "link": "id string, source string, target string, basis string",
    "control": "kind string, id string, enabled boolean, deleted boolean",
}


def export_area(spark: SparkSession, area: dict[str, DataFrame], path: str | None = None) -> str:
    """The records of an area as JSON lines that Spark writes, one folder a type. Missing types are empty."""
    path = path or f"{shared_folder(spark)}/area-{uuid.uuid4().hex}"
    for kind, schema in AREA.items():
        rows = area.get(kind)
        rows = spark.createDataFrame([], schema) if rows is None else rows.select(*[f"`{c.split()[0]}`" for c in schema.split(", ")])
        rows.write.json(f"{path}/{kind}")
    return path


def read_area(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {kind: spark.read.schema(schema).json(f"{path}/{kind}") for kind, schema in AREA.items()}


def new_id(area: str, kind: str, old: Column) -> Column:
    """Ids of the importing side: a digest of area, type and old id, so that a reference is remapped without a lookup."""
    return F.when(old.isNotNull(), F.substring(F.sha2(F.concat_ws("|", F.lit(area), F.lit(kind), old), 256), 1, 32))


def term_key(term: Column) -> Column:
    return F.trim(F.lower(term))


def area_problems(area: dict[str, DataFrame]) -> DataFrame:
    """``kind, id, problem``: what keeps an area from being imported, one row per record and problem.

    Ids that occur twice in a type; references to sources, profiles, cards or objects that the area lacks; citations whose offsets don't give their quote in the source's text;
    definitions among requirements and others among the glossary; choices whose key isn't the entry's term, or that occur twice; controls that are deleted and enabled, or occur twice.
    """
    found = []

    def problem(kind: str, rows: DataFrame, id_col: str, name: str):
        found.append(rows.select(F.lit(kind).alias("kind"), F.col(id_col).alias("id"), F.lit(name).alias("problem")).distinct())

    def absent(kind: str, rows: DataFrame, id_col: str, ref: str, known: DataFrame, name: str):
        problem(kind, rows.where(F.col(ref).isNotNull()).join(known.select(F.col("id").alias("_known")).distinct(), F.col(ref) == F.col("_known"), "left_anti"), id_col, name)

    cards = area["requirement"].unionByName(area["glossary"])
    for kind in ("source", "profile", "link"):
        problem(kind, area[kind].groupBy("id").count().where("count > 1"), "id", "id occurs twice")
    problem("card", cards.groupBy("id").count().where("count > 1"), "id", "id occurs twice")
    profiles = area["profile"]
    absent("profile", profiles.select("id", F.explode("parents").alias("ref")), "id", "ref", profiles, "parent absent")
    absent("profile", profiles.select("id", F.explode("sources").alias("ref")), "id", "ref", area["source"], "source absent")
    for kind in ("requirement", "glossary"):
        own = area[kind]
        absent(kind, own, "id", "source_id", area["source"], "source absent")
        absent(kind, own, "id", "local_profile", profiles, "profile absent")
        problem(kind, own.where((F.col("entity_type") == "definition") != F.lit(kind == "glossary")), "id", "wrong type")
        problem(kind, own.where(F.size(F.coalesce("citations", F.array())) < 1), "id", "no citation")
        cited = own.select("id", "source_id", F.inline("citations")).join(area["source"].select(F.col("id").alias("source_id"), "text"), "source_id")
        held = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text")) & (F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote"))
        problem(kind, cited.where(~F.coalesce(held, F.lit(False))), "id", "citation not in its source")
    choices = area["choice"].join(area["glossary"].select(F.col("id").alias("active_entry_id"), "term"), "active_entry_id", "left")
    problem("choice", choices.where(~F.coalesce(term_key(F.col("term")) == F.col("key"), F.lit(False))), "key", "entry of another term")
    problem("choice", area["choice"].groupBy("key").count().where("count > 1"), "key", "key occurs twice")
    for ref in ("source", "target", "basis"):
        absent("link", area["link"], "id", ref, cards, f"{ref} absent")
    objects = reduce(DataFrame.unionByName, [rows.select(F.lit(kind).alias("_kind"), F.col("id").alias("_known")) for kind, rows in (("source", area["source"]), ("profile", profiles), ("card", cards), ("link", area["link"]))])
    problem("control", area["control"].join(objects, (F.col("kind") == F.col("_kind")) & (F.col("id") == F.col("_known")), "left_anti"), "id", "object absent")
    problem("control", area["control"].where("enabled and deleted"), "id", "deleted and enabled")
    problem("control", area["control"].groupBy("kind", "id").count().where("count > 1"), "id", "control occurs twice")
    return reduce(DataFrame.unionByName, found)


def import_area(area: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """The area under new ids: every reference is remapped, and citations are bound to the new source by ``context``, a digest of the quoted text with its place."""
    card = lambda c: new_id(name, "card", F.col(c))
    source = new_id(name, "source", F.col("source_id"))
    bound = F.transform("citations", lambda c: F.struct(c["locator"], c["quote"], c["start"], c["end"], F.sha2(F.concat_ws("|", source, c["locator"], c["start"].cast("string"), c["quote"]), 256).alias("context")))
    remap = lambda kind, c: F.transform(c, lambda x: new_id(name, kind, x))
    cards = {k: area[k].withColumn("citations", bound).withColumn("id", card("id")).withColumn("source_id", source).withColumn("local_profile", new_id(name, "profile", F.col("local_profile"))) for k in ("requirement", "glossary")}
    kinds = reduce(lambda c, k: c.when(F.col("kind") == k, new_id(name, k, F.col("id"))), ("source", "profile", "card", "link"), F.when(F.lit(False), ""))
    return cards | {
        "source": area["source"].withColumn("id", new_id(name, "source", F.col("id"))),
        "profile": area["profile"].select(new_id(name, "profile", F.col("id")).alias("id"), "name", remap("profile", "parents").alias("parents"), remap("source", "sources").alias("sources")),
        "choice": area["choice"].withColumn("active_entry_id", card("active_entry_id")),
        "link": area["link"].select(new_id(name, "link", F.col("id")).alias("id"), *[card(c).alias(c) for c in ("source", "target", "basis")]),
        "control": area["control"].withColumn("id", kinds),
    }


def _escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def report_lines(findings: DataFrame) -> DataFrame:
    """``category, id, part, markdown, html``: the lines of a report, in any order; ``part`` orders those of a finding, and a category's heading has a null id.

    ``findings``: category, id, issue, explanation, suggestion, quotes (array of strings). Null texts count as empty. No category is gathered: a writer sorts the lines.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    quotes = F.transform(F.coalesce("quotes", F.array().cast("array<string>")), lambda q: line("quote", F.replace(q, F.lit("\n"), F.lit("\n> "))))
    own = F.concat(F.array(line("finding", empty("issue")), line("text", empty("explanation")), line("text", F.concat(F.lit("Suggestion: "), empty("suggestion")))), quotes)
    rows = findings.select("category", "id", F.posexplode(own).alias("part", "line")).select("category", "id", "part", "line.*")
    heads = findings.select("category").distinct().select("category", F.lit(None).cast(findings.schema["id"].dataType).alias("id"), F.lit(0).alias("part"), F.lit("category").alias("kind"), F.coalesce(F.col("category").cast("string"), F.lit("")).alias("text"))
    marks = {"category": ("## ", "h2"), "finding": ("### ", "h3"), "text": ("", "p"), "quote": ("> ", "blockquote")}
    mark = lambda i: reduce(lambda c, k: c.when(F.col("kind") == k, marks[k][i]), marks, F.when(F.lit(False), ""))
    return heads.unionByName(rows).select("category", "id", "part", F.concat(mark(0), "text").alias("markdown"), F.concat(F.lit("<"), mark(1), F.lit(">"), _escaped(F.col("text")), F.lit("</"), mark(1), F.lit(">")).alias("html"))


def write_report(lines: DataFrame, path: str, form: str = "markdown") -> None:
    """Write the lines in the order of the report, one folder of files a category: ``markdown`` or ``html`` text, or ``csv`` and ``json`` rows."""
    order = ["category", F.col("id").asc_nulls_first(), "part"]
    sorted_ = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    if form in ("markdown", "html"):
        sorted_.select("category", F.col(form).alias("value")).write.partitionBy("category").text(path)
    else:
        sorted_.write.partitionBy("category").format(form).save(path)
