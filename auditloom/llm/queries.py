"""The registered queries of this subpackage: each applies one operator to its whole table.

``SQL`` holds DuckDB SQL for the queries that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import (
    divergence, embedding_dedup, mixing, ngram_join, piece_codec, quality_classifier, quality_rules, secret_scan, spelling,
    suffix_dedup, url_filter, warc, winnowing,
)
from auditloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op1_embedding_near_dedup"] = """
WITH RECURSIVE good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
norms AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM good),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM norms AS a JOIN norms AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_inner_product(a.v, b.v) >= 0.9 * a.norm * b.norm),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
lowest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN lowest ON lowest.x = vec_id LEFT JOIN counts ON counts.x = vec_id"""


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


SQL["op3_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(
        list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
rare AS (SELECT * FROM shingles WHERE g IN (SELECT g FROM shingles GROUP BY g HAVING count(*) > 1)),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM rare AS a JOIN rare AS b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
lowest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM sets JOIN lowest ON lowest.x = doc_id LEFT JOIN counts ON counts.x = doc_id"""


@query
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), "doc_id").drop("found")


@query
def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


_UNIFORM = "CAST(CAST(('0x' || substr(md5({0}), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
_IDENTITY = "coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))"
SQL["op5_mixing_sources"] = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
totals AS (SELECT sum(n) AS all_n, sum(pow(CAST(n AS DOUBLE), {mixing.TEMPERATURE})) AS all_w FROM counts),
rates AS (SELECT source, pow(CAST(n AS DOUBLE), {mixing.TEMPERATURE}) / all_w * all_n * 1.0 / n AS rate FROM counts, totals),
split AS (SELECT *, greatest(CAST(ceil(rate / {mixing.PART}) AS BIGINT), 1) AS parts FROM rates),
terms AS (SELECT source, parts, rate, j, CASE WHEN j = 0 THEN 1.0 ELSE CAST(product((rate / parts) / i) OVER (PARTITION BY source ORDER BY j) AS DOUBLE) END
                 * exp(-(rate / parts)) AS p
          FROM (SELECT source, parts, rate, j, CASE WHEN j = 0 THEN rate / parts ELSE j END AS i FROM split, range({mixing.TERMS}) AS r(j))),
cdf AS (SELECT source, parts, list(total ORDER BY j) AS cdf FROM (
            SELECT source, parts, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS total FROM terms) GROUP BY source, parts),
drawn AS (SELECT d.*, (SELECT sum(len(list_filter(cdf, lambda c: c <= u))) FROM (
              SELECT {_UNIFORM.format("'" + mixing.SEED + "|' || " + _IDENTITY + " || '|' || CAST(part AS VARCHAR)")} AS u
              FROM (SELECT unnest(range(1, parts + 1)) AS part))) AS copies
          FROM documents AS d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
copied AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, CAST(copies AS BIGINT) + 1)) AS INTEGER) AS copy FROM drawn)
SELECT *, {_UNIFORM.format("'" + mixing.SEED + "|order|' || " + _IDENTITY + " || '|' || CAST(copy AS VARCHAR)")} AS shuffle_key FROM copied"""


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.encode(docs, piece_codec.load(), verify=True).drop("text")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules)


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


SQL["op8_warc"] = f"""
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM rows),
firsts AS (SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM digests)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM firsts"""


@query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.default_labels(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), model)


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


@query
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op11_benchmark_decontamination"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
    SELECT item, w, least(len(w), {winnowing.WINDOW}) AS m, unnest(range(1, len(w) - least(len(w), {winnowing.WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
    SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
hits AS (SELECT r, m, i, g FROM places WHERE g IN (SELECT g FROM windows)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (
    SELECT DISTINCT r, item FROM hits JOIN windows USING (g)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    coalesce(digest, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


_LEVEL = f"CAST(1 + (CAST({divergence.SCALE} AS HUGEINT) * ({{0}} + 1)) // ({{1}} + {{2}}) AS HUGEINT)"
SQL["op12_source_divergence"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCUMENTS}),
used AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, CAST(coalesce(sum(lang_n), 0) AS HUGEINT) AS total, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
counts AS (SELECT lang, source, term, coalesce(n, 0) AS n, lang_n FROM groups JOIN kept USING (lang) LEFT JOIN used USING (lang, source, term)),
totals AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM counts GROUP BY lang, source),
levels AS (SELECT c.lang, c.source, c.term, c.n, {_LEVEL.format('c.n', 't.total', 'l.v')} AS p, {_LEVEL.format('c.lang_n', 'l.total', 'l.v')} AS q
           FROM counts AS c JOIN totals AS t USING (lang, source) JOIN langs AS l USING (lang)),
distances AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM levels AS a JOIN levels AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN distances AS d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM levels WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
