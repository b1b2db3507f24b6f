"""Quality rules: a decision list learned by sequential covering and applied as Spark conditions.

Rules are conjunctions of thresholds on text statistics. Each rule is grown on two thirds of the labelled
rows that no earlier rule covers, adding the threshold with the best information gain, then pruned
on the other third, dropping conditions from the end while precision does not fall. The list ends
when a pruned rule is no longer precise. The rules become one ordered ``CASE WHEN``.

Null or empty text: all counts 0, so the base rule rejects it. Repeated rows are judged one by one. Without
labelled rows the list is empty and only the base rule decides. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import utf8
from auditloom.llm.labelled import training_sample
from auditloom.llm.text_stats import COUNTS, FEATURES, measure


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, self.feature]
        return column > self.threshold if self.above else column <= self.threshold

    def column(self, features: Column) -> Column:
        value = features[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _best(x: np.ndarray, bad: np.ndarray, cuts: int) -> tuple[float, Condition | None]:
    """The condition with the largest gain: bad rows kept times the growth of the log precision."""
    start = np.log2((bad.sum() + 1e-9) / len(bad))
    best, found = 1e-6, None
    for feature in range(x.shape[1]):
        column = x[:, feature]
        for threshold in np.unique(np.quantile(column, np.linspace(0, 1, cuts + 1)[:-1])):
            over = column > threshold
            for above, side in ((True, over), (False, ~over)):
                kept, total = bad[side].sum(), side.sum()
                if kept and total < len(bad):
                    gain = kept * (np.log2(kept / total) - start)
                    if gain > best:
                        best, found = gain, Condition(feature, above, float(threshold))
    return best, found


def _precision(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    hit = covers(rule, x)
    return (bad[hit].sum() + 1) / (hit.sum() + 2)


def learn(x: np.ndarray, good: np.ndarray, min_precision: float = 0.9, max_conditions: int = 4, max_rules: int = 16,
          cuts: int = 64, min_cover: int = 5) -> list[Rule]:
    """An ordered list of rules that reject; every other row is accepted."""
    bad = good == 0
    pruning = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = left & ~pruning, left & pruning
        if bad[grow].sum() < min_cover:
            break
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < max_conditions and not bad[inside].all():
            _, condition = _best(x[inside], bad[inside], cuts)
            if condition is None:
                break
            rule += (condition,)
            inside &= condition.holds(x)
        while len(rule) > 1 and _precision(rule[:-1], x[prune], bad[prune]) >= _precision(rule, x[prune], bad[prune]):
            rule = rule[:-1]
        hit = covers(rule, x) & left
        if not rule or hit.sum() < min_cover or bad[hit].mean() < min_precision or _precision(rule, x[prune], bad[prune]) < min_precision - 0.1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule], features: Column) -> tuple[Column, Column]:
    """Columns: accepted, and the number of the rule that rejects (null where none does)."""
    number = F.lit(None).cast("int")
    for n in reversed(range(len(rules))):
        condition = rules[n][0].column(features)
        for more in rules[n][1:]:
            condition &= more.column(features)
        number = F.when(condition, F.lit(n)).otherwise(number)
    return number.isNull(), number


SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"


def _measured(batches):
    for batch in batches:
        counts, features = [], []
        for text in utf8(batch.column("text")):
            exact, values = measure(text)
            counts.append(exact)
            features.append(values)
        columns = [pa.array(c, pa.int64()) for c in zip(*counts)] or [pa.array([], pa.int64())] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns, pa.array(features, pa.list_(pa.float64()))],
                                         ["doc_id", *COUNTS, "features"])


def statistics(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the exact counts and the feature vector."""
    return docs.select("doc_id", "text").mapInArrow(_measured, SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts, the base rule, the rejecting rule's number and the final decision per document."""
    accepted, number = verdict(rules, F.col("features"))
    return (statistics(docs).select("doc_id", *COUNTS, base_failed().alias("base_failed"), number.alias("rule"), accepted.alias("accepted"))
            .select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("accepted")).alias("kept"), "rule"))


def learn_rules(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    x, y = training_sample(docs, labels, "quality")
    return learn(x, y)
