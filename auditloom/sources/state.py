"""State tables, snapshots and exports on a file system."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditloom import rules as R
from auditloom.functions import text as T
from auditloom.operators import rollups
from auditloom.operators.findings import select_for_export

INDEX_SCHEMA = ("id STRING, name STRING, target STRING, savedAt TIMESTAMP, findingsCount MAP<STRING, BIGINT>, "
                "phase STRING, deleted BOOLEAN")


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _file_system(spark, path)
    return fs.exists(hadoop_path)


def _pointers(fs, folder) -> list[str]:
    """Names of a state table's pointers, oldest first."""
    return sorted(status.getPath().getName() for status in fs.listStatus(folder)) if fs.exists(folder) else []


def read_state(spark: SparkSession, path: str, schema: str | StructType, multi_line: bool = True) -> DataFrame:
    """A JSON state table; a missing one is empty. Plain JSON that ``write_state`` did not write is read as it stands."""
    folder, fs = _file_system(spark, f"{path}/_current")
    pointers = _pointers(fs, folder)
    if not pointers and not exists(spark, path):
        return spark.createDataFrame([], schema)
    where = f"{path}/data/{pointers[-1].partition('-')[2]}" if pointers else path
    return spark.read.schema(schema).option("multiLine", multi_line).json(where)


def write_state(df: DataFrame, path: str, keep: int = 2) -> None:
    """Replace a state table. The rows are written as immutable files; then one empty pointer file, named after number and folder, is
    created, and readers take the newest. So there is always a whole table to read. The ``keep`` newest are kept for those still reading.
    A plain file in the table's place is set aside first and deleted last.
    """
    spark = df.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    target, fs = _file_system(spark, path)
    version, aside = uuid.uuid4().hex, None
    fresh = f"{path}.{version[:8]}.tmp"
    df.write.mode("errorifexists").json(fresh)
    if fs.exists(target) and fs.getFileStatus(target).isFile():
        aside = make(f"{path}.{version[:8]}.old")
        if not fs.rename(target, aside):
            raise OSError(f"{path} could not be set aside; the new rows are in {fresh}")
    fs.mkdirs(make(f"{path}/data"))
    fs.mkdirs(make(f"{path}/_current"))
    if not fs.rename(make(fresh), make(f"{path}/data/{version}")):
        raise OSError(f"{path} is as before; the new rows are in {fresh}")
    pointers = _pointers(fs, make(f"{path}/_current"))
    number = int(pointers[-1].partition("-")[0]) + 1 if pointers else 0
    fs.create(make(f"{path}/_current/{number:012d}-{version}"), False).close()
    for old in _pointers(fs, make(f"{path}/_current"))[:-keep]:
        fs.delete(make(f"{path}/_current/{old}"), False)
        fs.delete(make(f"{path}/data/{old.partition('-')[2]}"), True)
    if aside is not None:
        fs.delete(aside, True)


# --- snapshots ---------------------------------------------------------------------------------

def save_snapshot(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame], target: str = "",
                  phase: str = "unknown") -> str:
    """Copy all relations under a new id and append one index row with the severity summary."""
    if not name or not name.strip():
        raise ValueError("name is required")
    snapshot = uuid.uuid4().hex[:8]
    for relation, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/snapshots/{snapshot}/{relation}")
    counts = F.map_from_arrays(F.array(*[F.lit(s) for s in R.SEVERITIES]), F.array(*[
        F.coalesce(F.col(s), F.lit(0)).cast("long") for s in R.SEVERITIES]))
    if "findings" in tables:
        summary = rollups.severity_summary_valid(tables["findings"].withColumn("__all", F.lit(1)), "__all")
        summary = spark.range(1).join(summary, F.lit(True), "left")
    else:
        summary = spark.range(1).select(*[F.lit(0).cast("long").alias(s) for s in R.SEVERITIES])
    summary.select(
        F.lit(snapshot).alias("id"), F.lit(name.strip()[:100]).alias("name"), F.lit(target).alias("target"),
        F.current_timestamp().alias("savedAt"), counts.alias("findingsCount"), F.lit(phase).alias("phase"),
        F.lit(False).alias("deleted"),
    ).write.mode("append").parquet(f"{root}/index")
    return snapshot


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Index rows, newest first, without deleted snapshots."""
    if not exists(spark, f"{root}/index"):
        return spark.createDataFrame([], INDEX_SCHEMA).drop("deleted")
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{root}/index")
    gone = index.filter("deleted").select("id").distinct()
    return index.filter("NOT deleted").join(gone, "id", "left_anti").drop("deleted").orderBy(F.desc("savedAt"), "id")


def _check_id(snapshot: str) -> None:
    if not re.fullmatch(r"[a-f0-9]{8}", snapshot):
        raise ValueError("Invalid snapshot id")


def load_snapshot(spark: SparkSession, root: str, snapshot: str, relations: list[str]) -> dict[str, DataFrame]:
    """Relations of a snapshot; ones it does not hold are left out."""
    _check_id(snapshot)
    base = f"{root}/snapshots/{snapshot}"
    if not exists(spark, base):
        raise FileNotFoundError("Snapshot not found")
    return {name: spark.read.parquet(f"{base}/{name}") for name in relations if exists(spark, f"{base}/{name}")}


def delete_snapshot(spark: SparkSession, root: str, snapshot: str) -> None:
    """Remove a snapshot; doing it twice changes nothing. The index gets a deletion row, never a rewrite."""
    _check_id(snapshot)
    hadoop_path, fs = _file_system(spark, f"{root}/snapshots/{snapshot}")
    fs.delete(hadoop_path, True)
    if exists(spark, f"{root}/index"):
        spark.createDataFrame([(snapshot, None, None, None, None, None, True)], INDEX_SCHEMA).write.mode(
            "append").parquet(f"{root}/index")


# --- exports -----------------------------------------------------------------------------------

def export_json(findings: DataFrame, path: str, ids=None) -> None:
    select_for_export(findings, ids).write.mode("overwrite").json(path)


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def issue_rows(findings: DataFrame) -> DataFrame:
    """Title, body and labels of one issue per finding."""
    label, mark = T.severity_label("severity"), T.severity_mark("severity")
    body = F.concat_ws(
        "\n", F.concat(F.lit("## "), _blank("title")), F.lit(""),
        F.concat(F.lit("**Severity**: "), mark, F.lit(" "), label), F.concat(F.lit("**Bug Class**: "), _blank("bugClass")),
        F.concat(F.lit("**File**: "), _blank("file"), F.lit(":"), _blank("line")),
        F.concat(F.lit("**Agent**: "), _blank("agent")), F.lit(""),
        F.lit("### Description"), _blank("description"), F.lit(""), F.lit("### Proof"), _blank("proof"), F.lit(""),
        F.lit("### Recommendation"), _blank("recommendation"))
    return findings.select(
        "repo", "id", F.concat(F.lit("["), label, F.lit("] "), _blank("title")).alias("title"), body.alias("body"),
        F.concat(F.lit("security,"), F.col("severity")).alias("labels"))


def report_sections(findings: DataFrame, repo: str = "repo", seq: str = "seq") -> DataFrame:
    """A Markdown report as ordered sections: summary lines, severity headings, one section per finding.

    Sections are rows (repo, part, rank, seq, text); sorting by the first four gives the document.
    """
    known = findings.filter(F.col("severity").isin(R.SEVERITIES)).withColumn("rank", T.severity_rank("severity"))
    label = T.severity_label("severity")
    titled = F.concat(T.severity_mark("severity"), F.lit(" "), label)
    body = F.concat_ws(
        "\n", F.concat(F.lit("### "), _blank("id"), F.lit(": "), _blank("title")), F.lit(""),
        F.concat(F.lit("**File**: `"), _blank("file"), F.lit(":"), _blank("line"), F.lit("`")),
        F.concat(F.lit("**Bug Class**: "), _blank("bugClass")), F.lit(""), F.lit("#### Description"),
        _blank("description"), F.lit(""), F.lit("#### Proof"), _blank("proof"), F.lit(""),
        F.lit("#### Recommendation"), _blank("recommendation"), F.lit(""), F.lit("---"), F.lit(""))
    counts = rollups.count_by_severity(findings, repo)
    total = findings.groupBy(repo).agg(F.count(F.lit(1)).alias("n"))

    def part(df, number, rank, order, text):
        return df.select(repo, F.lit(number).cast("long").alias("part"), rank.cast("long").alias("rank"),
                         order.cast("long").alias("seq"), text.alias("text"))

    zero = F.lit(0)
    head = F.concat(F.lit("# Security Audit Report\n\n**Target**: "), F.col(repo), F.lit("\n**Findings**: "),
                    F.col("n").cast("string"), F.lit("\n\n## Summary\n\n| Severity | Count |\n|----------|-------|"))
    row = F.concat(F.lit("| "), titled, F.lit(" | "), F.col("count").cast("string"), F.lit(" |"))
    heading = F.concat(F.lit("## "), titled, F.lit(" Findings\n"))
    return (
        part(total, 0, zero, zero, head)
        .unionByName(part(counts, 1, F.col("rank"), zero, row))
        .unionByName(part(total, 2, zero, zero, F.lit("\n---\n")))
        .unionByName(part(counts, 3, F.col("rank"), F.lit(-1), heading))
        .unionByName(part(known, 3, F.col("rank"), F.col(seq), body))
    )


def export_report(findings: DataFrame, path: str, ids=None) -> None:
    """Write the report as text, one folder per repo, range-sorted so that files in order are the document."""
    sections = report_sections(select_for_export(findings, ids))
    ordered = sections.repartitionByRange("repo", "part", "rank", "seq").sortWithinPartitions(
        "repo", "part", "rank", "seq")
    ordered.select("repo", "text").write.mode("overwrite").partitionBy("repo").text(path)
