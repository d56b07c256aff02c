"""What the operators of this subpackage that read texts in Python share: bounded Arrow batches, chunks of texts, and the core's hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkloom.functions.words import CHUNK_BYTES, hash_words, lowered, mix, shingle_hashes  # noqa: F401


def small_batches(docs: DataFrame) -> SparkSession:
    """The session of ``docs``, with Arrow batches held to 4 MB: batches of a number of rows can hold that many long texts."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts have about CHUNK_BYTES together, with those texts; null counts as empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        begin = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK_BYTES or i + 1 == len(texts):
                yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, size = i + 1, 0
