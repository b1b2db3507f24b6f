"""Routing rows to agents and protocols by keyword tables, and the taxonomy joins.

Keyword tables are configuration. They become column expressions, so a substring match is a
projection and never a nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions import text as T
from auditloom.operators.lines import bind


def keyword_table(df: DataFrame, name: str = "name", word: str = "keyword") -> dict[str, list[str]]:
    """A keyword DataFrame as the mapping the operators take; a null keyword names a catch-all.

    The table is configuration: it is as large as what people wrote down, whatever the corpus.
    """
    table: dict[str, list[str]] = {}
    for row in df.select(name, word).orderBy(name, word).collect():
        words = table.setdefault(row[0], [])
        if row[1] is not None:
            words.append(row[1])
    return table


def _matching(text: Column, table: dict[str, list[str]]) -> Column:
    """Names whose keywords the text holds; the text is built once, not once per keyword."""
    return bind(text, lambda blob: F.array_compact(F.array(*[
        F.when(T.any_contains(blob, words) if words else F.lit(True), F.lit(name)) for name, words in table.items()
    ])))


def route_leads(leads: DataFrame, table: dict[str, list[str]] = R.LEAD_KEYWORDS, out: str = "domain") -> DataFrame:
    """One row per lead and domain it concerns; a domain without keywords receives every lead.

    The tests are columns of a projection, which is compiled; inside an array function each would be interpreted.
    """
    fields = [F.coalesce(F.col(name), F.lit("")) for name in ("message", "rule", "file", "snippet")]
    blob = leads.withColumn("__blob", F.lower(F.concat_ws(" ", *fields)))
    flags = {f"__takes_{n}": T.any_contains(F.col("__blob"), _needed(words)) if words else F.lit(True) for n, words in enumerate(table.values())}
    takers = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(name)) for flag, name in zip(flags, table)]))
    return blob.select(*leads.columns, *[test.alias(flag) for flag, test in flags.items()]).select(*leads.columns, F.explode(takers).alias(out))


def _needed(words: list[str]) -> list[str]:
    """Words without those that hold another one of the list, which a text then holds too."""
    return [word for word in dict.fromkeys(words) if not any(other != word and other in word for other in words)]


def route_by_type(rows: DataFrame, table: dict[str, list[str]] = R.INVARIANT_ROUTES, on: str = "type",
                  out: str = "agent") -> DataFrame:
    """Send each row to the agents that take its type: invariants by type, extracts by relation name."""
    takers = F.array_compact(F.array(*[F.when(F.col(on).isin(kinds), F.lit(agent)) for agent, kinds in table.items()]))
    return rows.select("*", F.explode(takers).alias(out))


def match_protocols(docs: DataFrame, table: dict[str, list[str]] = R.PROTOCOL_KEYWORDS, text: Column | None = None,
                    out: str = "protocol") -> DataFrame:
    """One row per document and protocol it mentions; a document that mentions none gets all of them."""
    blob = text if text is not None else T.search_blob(docs)
    everything = F.array(*[F.lit(name) for name in table])

    def rows(found):
        missed = F.size(found) == 0
        return F.transform(F.when(missed, everything).otherwise(found),
                           lambda name: F.struct(name.alias("name"), missed.alias("missed")))

    return docs.select("*", F.explode(bind(_matching(blob, table), rows)).alias("__m")).select(
        *docs.columns, F.col("__m.name").alias(out), F.col("__m.missed").alias("fallback"))


def sections_for_agent(sections: DataFrame, table: dict[str, list[str]] = R.HEURISTIC_ROUTES, repo: str = "repo",
                       key: str = "key", text: str = "section", position: str = "position") -> DataFrame:
    """Each agent's sections joined in mapping order; the last section of a key counts, missing ones are skipped.

    A result holds at most as many sections as the mapping lists, whatever the table's size.
    """
    wanted = sorted({name for names in table.values() for name in names})
    last = sections.filter(F.col(key).isin(wanted)).groupBy(repo, key).agg(F.max_by(text, position).alias("__text"))
    pairs = F.array(*[
        F.struct(F.lit(agent).alias("agent"), F.lit(number).alias("number"), F.lit(name).alias("name"))
        for agent, names in table.items() for number, name in enumerate(names)
    ])
    spread = last.select(repo, key, "__text", F.explode(F.filter(pairs, lambda p: p["name"] == F.col(key))).alias("__p"))
    ordered_text = F.sort_array(F.collect_list(F.struct("__p.number", "__text")))
    return spread.groupBy(repo, F.col("__p.agent").alias("agent")).agg(
        F.array_join(F.transform(ordered_text, lambda s: s["__text"]), "\n\n").alias("text"),
        F.count(F.lit(1)).alias("sections"))


def findings_with_class(findings: DataFrame, taxonomy: DataFrame, key: str = "bugClass") -> tuple[DataFrame, DataFrame]:
    """Findings with the domain, reference and owner of their class, and the findings of unknown classes."""
    renamed = taxonomy.select(F.col("id").alias(key), "domain", "ref", F.col("agent").alias("class_agent"))
    return findings.join(renamed, key, "left"), findings.join(renamed, key, "left_anti")


def ref_order(ref: str | Column = "ref") -> list[Column]:
    """Numeric order of major.minor references: 1.9 comes before 1.10."""
    parts = F.split(T.col(ref), r"\.")
    return [F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1)).try_cast("long")]


def order_taxonomy(taxonomy: DataFrame, ref: str = "ref") -> DataFrame:
    return taxonomy.orderBy(*ref_order(ref))
