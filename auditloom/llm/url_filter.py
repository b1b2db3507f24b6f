"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled table of URLs. A URL that no rule decides is blocked where the model's probability of
a bad page is at least one half. Null URLs and those without ``://`` have empty host and path, match no rule and
are scored as an empty host and path, by the n-grams of the end marks. Repeated rows are judged one by one; other columns are not read.
Parsing, features and scores are built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, WIDTHS, MAX_LABELLED = 4096, (3, 4), 10_000

#: (host and path, verdict); a rule fits its host and all subdomains.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

# Names of own choice: hosts to keep out, and ordinary ones.
BAD_NAMES = ("casino-online", "free-bets", "adult-x", "xxx-videos", "cheap-pills", "poker-bonus", "win-prize", "hot-singles", "payday-loans",
             "replica-watches", "torrent-free", "slots-jackpot", "porn-tube", "bet-now", "viagra-store", "spam-links", "click-ads", "link-farm")
GOOD_NAMES = ("gardening", "library", "university", "weather", "museum", "history", "recipes", "thing", "other", "forum", "health", "school",
              "maps", "another", "theatre", "nation", "station", "therapy", "athens", "hearing", "reason", "notions", "inshore", "thorn")
#: The labelled URL table, 1 for pages to keep out: each name below each ending, with paths that tell nothing.
LABELLED = tuple((f"http://{name}.example.{ending}/{('en', 'de', 'fr', 'es')[n % 4]}/{7 * n}", label)
                 for label, names in ((1, BAD_NAMES), (0, GOOD_NAMES)) for ending in ("com", "net", "org")
                 for prefix in ("", "blog.", "m.") for n, name in enumerate(prefix + x for x in names))


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path of a URL."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def grams(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of host and path, each between end marks; the text becomes characters once, so time is linear."""
    def buckets(chars, n):
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.pmod(
            F.xxhash64(F.concat(*[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(n)])), F.lit(BUCKETS)).cast("int"))

    chars = F.split(F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$")), "")
    return F.get(F.transform(F.array(chars), lambda held: F.concat(*[buckets(held, n) for n in WIDTHS])), F.lit(0))


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: tuple[float, ...]

    def score(self, host: Column, path: Column) -> Column:
        """Probability that the page is to be kept out."""
        table = F.split(F.lit(",".join(repr(w) for w in self.weights)), ",").cast("array<double>")  # folded to one constant
        found = grams(host, path)
        total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(table, b))
        return 1 / (1 + F.exp(-(F.lit(self.intercept) + total / F.sqrt(F.size(found).cast("double")))))


def train(labelled: DataFrame, rounds: int = 500, rate: float = 30.0, ridge: float = 1e-4) -> Model:
    """Fit on a table ``(url, label)``; of more than ``MAX_LABELLED`` rows, those with the smallest hashes count.

    Rows with a null label are left out. A table without both labels gives the constant model.
    """
    host, path = parts(F.col("url"))
    rows = (labelled.where(F.col("label").isNotNull()).orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED)
            .select("label", grams(host, path).alias("grams")).collect())
    y = np.array([r.label for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), (0.0,) * BUCKETS)
    x = np.zeros((len(rows), BUCKETS))
    for n, r in enumerate(rows):
        np.add.at(x[n], r.grams, 1 / np.sqrt(len(r.grams)))
    weights, intercept = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        slope = 1 / (1 + np.exp(-(x @ weights + intercept))) - y
        weights -= rate * (x.T @ slope / len(y) + ridge * weights)
        intercept -= rate * slope.mean()
    return Model(round(float(intercept), 9), tuple(round(float(w), 9) for w in weights))


def default_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED), "url string, label int")


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict), null where none fits.

    The rules lie in one map by host; each suffix of a URL's host is looked up once.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        where, slash, rest = rule.partition("/")
        by_host.setdefault(where, []).append((rule, slash + rest, verdict))
    kind = "array<struct<size:int,rule:string,path:string,verdict:string>>"
    entry = lambda own: F.array(*[F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
                                  for r, p, v in own]).cast(kind)
    table = F.create_map(*[c for where, own in by_host.items() for c in (F.lit(where), entry(own))])
    # Only suffixes of as many labels as some rule's host has; a host of fewer is its own suffix, which a repeated look-up does not change.
    suffixes = F.array(*[F.substring_index(host, ".", -size) for size in sorted({where.count(".") + 1 for where in by_host})])
    hits = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast(kind))))
    return F.array_max(F.filter(hits, lambda r: path.startswith(r["path"])))


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and the model's score."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("score", model.score(F.col("host"), F.col("path")))
    return rows.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"),
                       F.coalesce(F.col("__rule.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
