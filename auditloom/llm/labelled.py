"""A bounded sample of labelled feature rows, for models that are trained on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import utf8
from auditloom.llm.text_stats import FEATURES, measure

#: Labelled rows a model is trained on at most; they are those with the smallest hashes of their ids.
MAX_TRAINING_ROWS = 20_000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _feature_rows(batches):
    for batch in batches:
        rows = [measure(text)[1] for text in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["label", "features"])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of at most ``max_rows`` labelled documents outside the held-out fold.

    Rows without id or label are left out; a document labelled twice counts with its larger label.
    An empty label table gives empty arrays.
    """
    known = (labels.select("doc_id", F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
             .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label")  # max_rows bounds the side
    got = rows.mapInArrow(_feature_rows, "label int, features array<double>").collect()
    x = np.array([r.features for r in got], float).reshape(len(got), len(FEATURES))
    y = np.array([r.label for r in got], int)
    order = np.lexsort([*x.T[::-1], y])  # the order of arrival must not matter
    return x[order], y[order]
