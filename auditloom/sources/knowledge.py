"""Reference knowledge: taxonomies, Markdown sections, manifest sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.text import strip

TAXONOMY_SCHEMA = "classes MAP<STRING, STRUCT<domain: BIGINT, ref: STRING, agent: STRING>>"


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of classes as rows (id, domain, ref, agent)."""
    return parse_taxonomy(spark.read.text(path, wholetext=True))


def parse_taxonomy(documents: DataFrame, text: str = "value") -> DataFrame:
    """The same from a column of JSON texts, beside their other columns."""
    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.explode(F.from_json(text, TAXONOMY_SCHEMA)["classes"]).alias("id", "m")).select(
        *others, "id", "m.domain", "m.ref", "m.agent")


def split_sections(docs: DataFrame, text: str = "text", heading: str = r"### (H\d+):.+", stop_at_rule: str = "always",
                   keys: list[str] = ("repo",)) -> DataFrame:
    """Markdown sections that open with ``heading``: its captured key, the position and the trimmed text.

    A section ends at the next such heading. A ``---`` line also ends it: every section with
    ``always``, only a document's last one with ``last``.
    """
    pieces = F.split(F.col(text), rf"(?m)(?=^{heading}$)")
    rows = docs.filter(F.rlike(text, F.lit(rf"(?m)^{heading}$"))).select(
        *keys, F.posexplode(F.transform(pieces, lambda piece, i: F.struct(
            piece.alias("piece"), (i == F.size(pieces) - 1).alias("last")))).alias("__pos", "__p"))
    rows = rows.select(*keys, F.col("__pos").cast("long").alias("position"), "__p.*")
    rows = rows.filter(F.rlike("piece", F.lit(rf"^{heading}(?:\n|\z)")))
    cut = F.substring_index("piece", "\n---\n", 1)
    section = cut if stop_at_rule == "always" else F.when(F.col("last"), cut).otherwise(F.col("piece"))
    return rows.select(*keys, "position", F.regexp_extract("piece", f"^{heading}", 1).alias("key"),
                       strip(section).alias("section"))


def extract_manifest_sections(docs: DataFrame, text: str = "content", keys: list[str] = ("repo", "path")) -> DataFrame:
    """Dependency sections of manifest text, joined by line breaks; rows without any are left out."""
    found = F.regexp_extract_all(text, F.lit(r"\[(dependencies|dev-dependencies)\][\s\S]*?(?=\n\[|\z)"), F.lit(0))
    return docs.filter(F.contains(text, F.lit("dependencies]"))).select(
        *keys, F.array_join(found, "\n").alias("sections")).filter(F.col("sections") != "")
