"""Vector retrieval: nearest neighbours of a query set and contexts made of what they find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.lists import list_join, ordered_list
from sparkloom.functions.text import format_template
from sparkloom.functions.vector import cosine_distance
from sparkloom.operators.relational import top_k_per_group
from sparkloom.storage import small_batches, spread


#: Packed query blocks that are broadcast (8 MB at 1 000 vectors of 64 numbers each are 16 of them); more are held against the rows by a cartesian product.
FEW_BLOCKS = 16


def _packed(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(keys, n, x): up to ``size`` rows' unit vectors of one length as one row, in the order of their keys. Rows without a direction go."""
    source = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            for n in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == n)
                for begin in range(0, len(at), size):
                    some = batch.take(pa.array(at[begin : begin + size]))
                    some = some.take(pc.sort_indices(some.column(0)))
                    numbers = some.column(1).flatten()
                    x = numbers.to_numpy(zero_copy_only=False).reshape(-1, n)
                    norm = np.sqrt((x * x).sum(1))
                    has = (norm != 0) & numbers.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n).all(1)
                    keys = some.column(0).filter(pa.array(has))
                    if len(keys):
                        with np.errstate(invalid="ignore"):
                            unit = x[has] / norm[has, None]
                        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([int(n)], pa.int32()), pa.array([unit.tobytes()], pa.binary())], ["keys", "n", "x"])

    return source.mapInArrow(run, f"keys array<{source.schema['key'].dataType.simpleString()}>, n int, x binary")


def _nearest(q: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, row of x, distance): the k rows of x nearest to each row of q, ties to the first, some rows of q at a time."""
    step = max(1, (1 << 19) // len(x))
    for begin in range(0, len(q), step):
        d = np.floor((1 - np.clip(q[begin : begin + step] @ x.T, -1, 1)) * 1e9 + 0.5) / 1e9
        d[np.isnan(d)] = np.inf
        if k < len(x):
            last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            less, same = d < last, d == last
            of, at = np.nonzero(less | (same & (np.cumsum(same, axis=1) <= k - less.sum(1, keepdims=True))))
        else:
            of, at = np.nonzero(np.ones_like(d))
        found = d[of, at]
        found[np.isinf(found)] = np.nan
        yield of + begin, at, found


def knn(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query_embedding", block: int = 1000) -> DataFrame:
    """(query_key, key, distance, rank): the k corpus rows nearest to each query by cosine distance to nine digits, ties by key.

    All queries are held against all rows: ``block`` queries and a few thousand rows at a time are one matrix product in a task, of which only
    the k best of each query go on. The work grows with queries times rows; a task's memory doesn't grow. Rows are read once.
    """
    small_batches(corpus)
    blocks = max(1, -(-queries.count() // block))
    asked = _packed(queries.repartition(blocks), query_key, query_vector, block).toDF("ids", "m", "q")
    rows = _packed(spread(corpus.select(key, vector)), key, vector, 4096)
    pairs = rows.crossJoin(F.broadcast(asked) if blocks <= FEW_BLOCKS else asked).select("keys", "x", "n", "ids", "q", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, x, n, ids, q, m in zip(*batch.columns, strict=True):
                # Told apart here: as a condition of the join, equal lengths would bring all blocks to one task where none are broadcast.
                if n != m:
                    continue
                x, q = (np.frombuffer(b.as_buffer()).reshape(-1, n.as_py()) for b in (x, q))
                for of, at, distance in _nearest(q, x, k):
                    yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(of)), keys.values.take(pa.array(at)), pa.array(distance)], [query_key, key, "distance"])

    kinds = dict(queries.dtypes)[query_key], dict(corpus.dtypes)[key]
    scored = pairs.mapInArrow(run, f"`{query_key}` {kinds[0]}, `{key}` {kinds[1]}, distance double")
    return top_k_per_group(scored, [query_key], [F.col("distance").asc(), F.col(key).asc()], k)


def global_top_k(corpus: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return corpus.withColumn("distance", cosine_distance(vector, q)).orderBy("distance", key).limit(k)


def contexts(found: DataFrame, by: str, text: str, separator: str = "\n\n---\n\n", rank: str = "rank") -> DataFrame:
    """(by, context): the texts found for each query in the order of their rank, as one string."""
    return found.groupBy(by).agg(list_join(ordered_list(rank, text), separator).alias("context"))


def few_shot(found: DataFrame, by: str, question: str, answer: str, rank: str = "rank") -> DataFrame:
    """(by, context): examples as question and answer lines, nearest first."""
    shown = found.withColumn("_example", format_template("Q: {}\nA: {}", question, answer))
    return contexts(shown, by, "_example", "\n\n", rank)
