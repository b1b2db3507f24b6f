"""Reading a corpus of text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import predicates as P

PROBED_BYTES = 8192


def is_binary(content: str | Column = "content") -> Column:
    """A zero byte among the first 8192 bytes; an unreadable file counts as binary."""
    c = F.col(content) if isinstance(content, str) else content
    return F.coalesce(F.contains(F.substring(c, 1, PROBED_BYTES), F.unhex(F.lit("00"))), F.lit(True))


def drop_binary(files: DataFrame, content: str = "content") -> DataFrame:
    return files.filter(~is_binary(content))


def read_corpus(spark: SparkSession, path: str, repo: str | Column = "", scannable_only: bool = True) -> DataFrame:
    """Text files below ``path`` as (repo, path, size, content), binary files and skipped directories left out.

    Paths are tested before the content column is touched. Bad bytes become replacement characters.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.regexp_replace(F.lit(path), r"^file:(?://)?|/+$", "")
    relative = F.regexp_replace(F.substr(F.col("path"), F.instr(F.col("path"), root) + F.length(root)), "^/+", "")
    picked = raw.withColumn("__path", relative).filter(~P.in_skipped_directory("__path"))
    if scannable_only:
        picked = picked.filter(P.is_scannable("__path"))
    return drop_binary(picked).select(
        (F.lit(repo) if isinstance(repo, str) else repo).alias("repo"), F.col("__path").alias("path"),
        F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def parse_manifest(lines: DataFrame, text: str = "value") -> DataFrame:
    """path, loc and language from tab-separated text rows, beside their other columns; malformed rows are dropped."""
    entry = F.from_csv(F.col(text), F.lit("path STRING, loc BIGINT, language STRING"), {"sep": "\t", "quote": ""})
    return lines.withColumn("__m", entry).where("__m.loc IS NOT NULL").select(*[c for c in lines.columns if c != text], "__m.*")


def read_manifest_tsv(spark: SparkSession, path: str) -> DataFrame:
    """path, loc and language from a tab-separated manifest; malformed rows are dropped."""
    return (
        spark.read.option("sep", "\t").option("mode", "DROPMALFORMED").option("quote", "")
        .schema("path STRING, loc BIGINT, language STRING").csv(path).filter("loc IS NOT NULL")
    )
