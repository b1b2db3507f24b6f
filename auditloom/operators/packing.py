"""Priority scores and budgeted packing of files into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions import predicates as P
from auditloom.functions import text as T
from auditloom.operators import ordered
from auditloom.session import durable

KEYWORD_BOOST = 100_000
INCLUDE_BOOST = 200_000


def priority_score(path: str | Column, loc: str | Column, keywords: list[str] = (),
                   includes: list[str] | Column = ()) -> Column:
    """Lines of the file, plus a boost for a keyword in its path and a larger one for an include pattern."""
    lowered = F.lower(T.col(path))
    score = T.col(loc).cast("long")
    if keywords:
        hit = T.any_contains(lowered, [word.lower() for word in keywords])
        score = score + F.when(hit, F.lit(KEYWORD_BOOST)).otherwise(F.lit(0))
    if isinstance(includes, Column) or includes:
        hit = P.matches_any_glob(path, includes)
        score = score + F.when(hit, F.lit(INCLUDE_BOOST)).otherwise(F.lit(0))
    return score


def _fold(budget: Column, batch: Column):
    """Walk one ordered batch: take what fits, skip what does not."""
    start = F.struct(budget.cast("long").alias("left"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc, item):
        fits = item["tokens"] <= acc["left"]
        return F.struct(
            F.when(fits, acc["left"] - item["tokens"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["taken"], F.array(item["seq"]))).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(batch, start, step)


def pack_budget(docs: DataFrame, budget: int = R.TOKEN_BUDGET, repo: str = "repo", score: str = "score",
                tokens: str = "tokens", seq: str = "seq", batch: int = 1024) -> DataFrame:
    """Mark ``included``: walk each repo by score, highest first, and take every file that still fits.

    A file that does not fit is skipped and the walk goes on, so a running total is not enough.
    The walk is exact and runs in rounds over narrow columns. A round folds the first ``batch``
    files per repo; then files larger than the room left, or already passed, drop out. Each round
    takes at least one file of every open repo, and room shrinks fast, so few rounds are needed;
    no task ever sees more than a batch per repo and salt. Files of zero tokens always fit.
    """
    items = docs.select(repo, F.col(seq).cast("long").alias(seq), F.col(score).cast("long").alias("score"),
                        F.col(tokens).cast("long").alias("tokens"))
    # The counts are taken from the texts once; every round then reads these narrow rows.
    items = durable(items.filter((F.col("tokens") > 0) & (F.col("tokens") <= budget)))
    order = [F.col("score").desc(), F.col(seq)]
    taken, room = None, None
    while True:
        # Files at or before the last folded place have been decided; larger ones can never fit.
        open_items = items if room is None else (
            items.join(room, repo).filter(
                (F.col("tokens") <= F.col("left"))
                & ((F.col("score") < F.col("last_score"))
                   | ((F.col("score") == F.col("last_score")) & (F.col(seq) > F.col("last_seq")))))
        )
        # The fold needs the room of its repo; before the first round that is the whole budget.
        if room is None:
            open_items = open_items.withColumn("left", F.lit(budget).cast("long"))
        open_items = open_items.select(repo, seq, "score", "tokens", "left")
        head = ordered.top_n(open_items, [repo], order, batch, seq)
        walked = (
            head.groupBy(repo, "left")
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col(seq).alias("seq"),
                                                      F.col("tokens").alias("tokens")))).alias("__batch"))
            .withColumn("__f", _fold(F.col("left"), F.col("__batch")))
            .select(repo, F.col("__f.left").alias("left"), F.col("__f.taken").alias("taken"),
                    (-F.element_at("__batch", -1)["o"]).alias("last_score"),
                    F.element_at("__batch", -1)["seq"].alias("last_seq"))
        )
        walked = durable(walked)
        if walked.isEmpty():
            break
        # Only repos walked in this round stay open; the rest had no candidate left.
        room = walked.drop("taken")
        picked = walked.select(repo, F.explode("taken").alias(seq))
        taken = picked if taken is None else taken.unionByName(picked)
    free = F.col(tokens) == 0
    if taken is None:
        return docs.withColumn("included", free)
    return (
        docs.join(taken.withColumn("__in", F.lit(True)), [repo, seq], "left")
        .withColumn("included", free | F.coalesce("__in", F.lit(False))).drop("__in")
    )


def packed_summary(packed: DataFrame, repo: str = "repo") -> DataFrame:
    """Per repo: packed and excluded files, lines and tokens, and the warning text if anything was left out."""
    kept = F.col("included")
    excluded = F.count_if(~kept)
    return packed.groupBy(repo).agg(
        F.count_if(kept).alias("included_files"), excluded.alias("excluded_files"),
        F.sum(F.when(kept, F.col("loc")).otherwise(F.lit(0))).alias("total_loc"),
        F.sum(F.when(kept, F.col("tokens")).otherwise(F.lit(0))).alias("total_tokens"),
    ).withColumn("warning", F.when(F.col("excluded_files") > 0, F.concat(
        F.lit("Large codebase, source truncated to fit context. "), F.col("excluded_files").cast("string"),
        F.lit(" file(s) excluded by budget."))))
