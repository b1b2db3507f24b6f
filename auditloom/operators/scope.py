"""Scope: which files count, which framework a repository uses, which directory a hint means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import predicates as P
from auditloom.functions import text as T
from auditloom.operators import ordered


def scope_filter(files: DataFrame, excluded: DataFrame | None = None, excludes: list[str] | Column = (),
                 repo: str = "repo", path: str = "path") -> DataFrame:
    """Drop listed paths, then paths that match an exclude pattern."""
    if excluded is not None:
        files = files.join(excluded.select(repo, path).distinct(), [repo, path], "left_anti")
    if isinstance(excludes, Column) or excludes:
        files = files.filter(~P.matches_any_glob(path, excludes))
    return files


def scope_manifest(corpus: DataFrame, keys: list[str] = ("repo", "path"), text: str = "content") -> DataFrame:
    """Path, lines of code and language of every file."""
    return corpus.select(*keys, T.count_loc(text).alias("loc"), P.manifest_language("path").alias("language"))


def detect_framework(files: DataFrame, repo: str = "repo", path: str = "path", text: str = "content") -> DataFrame:
    """anchor before pinocchio before native before unknown, from marker files and manifest text."""
    manifest = P.file_name(path) == "Cargo.toml"

    def mentions(word):
        return F.coalesce(F.max(manifest & F.contains(F.coalesce(text, F.lit("")), F.lit(word))), F.lit(False))

    marker = F.max(F.col(path) == "Anchor.toml")
    return files.groupBy(repo).agg(
        (marker | mentions("anchor-lang")).alias("__anchor"), mentions("pinocchio").alias("__pinocchio"),
        mentions("solana-program").alias("__native"),
    ).select(repo, F.when(F.col("__anchor"), "anchor").when(F.col("__pinocchio"), "pinocchio")
             .when(F.col("__native"), "native").otherwise("unknown").alias("framework"))


def fuzzy_pick(dirs: DataFrame, hint: str | Column, repo: str = "repo", path: str = "path", seq: str = "seq"):
    """The directory a hint means: its name contains the hint, an exact name wins, then the first seen.

    Paths are relative; hidden, dependency and build directories and anything deeper than four
    levels are not looked at. One pre-aggregated value per repo leaves a task.
    """
    h = F.lower(F.lit(hint) if isinstance(hint, str) else hint)
    name = F.lower(P.file_name(path))
    hidden = F.rlike(path, F.lit(r"(?:^|/)(?:\.[^/]*|node_modules|target)(?:/|$)"))
    depth = F.size(F.split(F.col(path), "/"))
    found = dirs.filter(~hidden & (depth <= 4) & F.contains(name, h))
    return found.groupBy(repo).agg(F.min_by(path, F.struct(
        F.when(name == h, F.lit(0)).otherwise(F.lit(1)), F.col(seq))).alias("directory"))


def directories(files: DataFrame, repo: str = "repo", path: str = "path", seq: str = "seq") -> DataFrame:
    """Distinct directories of a file list with the arrival number of their first file."""
    parts = F.split(F.col(path), "/")
    levels = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                         lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return (
        files.filter(F.contains(path, F.lit("/"))).select(repo, seq, F.explode(levels).alias(path))
        .groupBy(repo, path).agg(F.min(seq).alias(seq))
    )


def relevance_rank(value: str | Column) -> Column:
    return T.confidence_rank(value)


def rank_surfaces(surfaces: DataFrame, level: str = "threatLevel", seq: str = "seq") -> DataFrame:
    return surfaces.orderBy(T.severity_rank(level), seq)


def rank_categories(categories: DataFrame, relevance: str = "relevance", seq: str = "seq") -> DataFrame:
    return categories.orderBy(relevance_rank(relevance), seq)


def surface_position(surfaces: DataFrame, repo: str = "repo", level: str = "threatLevel", seq: str = "seq") -> DataFrame:
    """Position of every attack surface in its repository's order, without a global sort."""
    return ordered.row_number(surfaces.withColumn("rank", T.severity_rank(level)), [repo], seq, "position", ["rank"])


def category_position(categories: DataFrame, repo: str = "repo", relevance: str = "relevance", seq: str = "seq") -> DataFrame:
    return ordered.row_number(categories.withColumn("rank", relevance_rank(relevance)), [repo], seq, "position", ["rank"])
