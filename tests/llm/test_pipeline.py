"""The pipeline's stages on a small corpus with awkward rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import queries


def corpus(spark, folder):
    rng = random.Random(4)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."

    rows = [(n, prose(120), "en", f"s{n % 3}", 0) for n in range(60)]
    rows += [(100 + n, rows[n][1], "en", "s0", 0) for n in range(10)] + [(200 + n, "### " * 200 + str(n), "en", "s1", 0) for n in range(20)]
    rows += [(300, prose(90) + " password=hunter2hunter2", "en", "s2", 0), (301, None, None, None, None), (302, "", "en", "s0", 0), (None, prose(100), "en", "s1", 0), (5, rows[5][1], "en", "s2", 0)]
    labels = [(n, 1, 0) for n in range(60)] + [(200 + n, 0, 0) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")


def test_stages_take_effect(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{number}")
        docs = spark.read.parquet(f"{folder}/out{number}")
        kept[name] = docs
        if number < 4:
            assert docs.columns == columns
    ids = {r.doc_id for r in kept["quality classifier"].collect()}
    assert ids >= set(range(60)) | {300} and not ids & set(range(200, 220))
    once = [r.doc_id for r in kept["n-gram Jaccard join"].collect()]
    assert len(once) == len(set(once)) and not set(once) & set(range(100, 110))
    assert kept["secret scans"].where(F.col("text").contains("hunter2")).count() == 0
    assert kept["secret scans"].count() == kept["n-gram Jaccard join"].count()
    tokens = kept["SentencePiece encoding and decoding"]
    assert tokens.count() == kept["mixing sources to target weights"].count()
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, tokens.collect()))


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)


def test_near_duplicates_form_no_groups_of_sizes_that_cannot_link(spark, monkeypatch):
    """The pipeline's second stage sent each text of a group that shared but a passage to all blocks of the group."""
    import corpus_pipeline
    from auditloom.llm import ngram_join

    seen, whole = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: seen.append(edges.count()) or whole(edges))
    texts = [" ".join([f"p{n}" for n in range(40)] + [f"a{size}x{n}" for n in range(size)]) for size in (10, 30, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 3 and seen == [0, 0]
