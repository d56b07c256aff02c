"""A vector index that is searched without a full scan: inverted lists around centroids, with product codes of the residuals.

Centroids and codebooks are fitted on a bounded sample; every row is then put into the list of its nearest centroid, as a code of a few
bytes for what the centroid leaves over. Lists are partitions of a Parquet table. A query reads only its ``nprobe`` nearest lists, ranks
their codes by distances from a small table a list, and takes the exact distance for the best of them. Distances are cosine distances, as
:func:`sparkloom.operators.retrieval.knn` has them, and ties go to the lesser key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.vector import cosine_distance
from sparkloom.operators.relational import top_k_per_group
from sparkloom.storage import spread


@dataclass
class Index:
    """path: the table (key, list, code) and, below ``model``, the fitted vectors."""

    path: str
    key: str
    vector: str
    centroids: np.ndarray
    books: np.ndarray  # subspace, code, coordinates
    nprobe: int
    candidates: int


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centres of each row, nearest first, ties by number."""
    d = (centres**2).sum(1) - 2 * x @ centres.T
    if n == 1:
        return d.argmin(1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def lloyd(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """k-means on a sample: random rows to begin with, empty clusters restart at the rows that are farthest from theirs."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)[:, 0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            far = np.argsort(-((x - centres[own]) ** 2).sum(1), kind="stable")[: (~full).sum()]
            centres[~full] = x[far]
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    return unit(np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)) if len(column) else np.empty((0, 0))


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, subspaces: int = 8, codes: int = 64, sample: int = 20_000, recall: float = 0.95) -> Index:
    """Fit on the ``sample`` rows with the least hashes of their keys, and write every row with a vector to its list.

    ``lists`` is about the root of the number of rows by default. How many lists a query reads, and for how many rows it takes the exact
    distance, is measured on the sample: as few as find ``recall`` of the ten nearest rows there. Vectors without clusters need many lists. The length of vectors must be a multiple of ``subspaces``. Rows without a vector
    are in no list, as they have no distance; null keys and repeated rows are rows like others.
    """
    spark, some = vectors.sparkSession, vectors.filter(F.col(vector).isNotNull())
    if lists is None:
        lists = max(1, int(some.count() ** 0.5))
    taken = some.select(vector).orderBy(F.xxhash64(key), F.xxhash64(vector)).limit(sample).toArrow()
    x = _matrix(taken.column(0).combine_chunks()) if taken.num_rows else np.zeros((1, subspaces))
    centroids = lloyd(x, min(lists, 4096))
    rest = (x - centroids[nearest(x, centroids)[:, 0]]).reshape(len(x), subspaces, -1)
    books = np.zeros((subspaces, codes, rest.shape[2]))
    for s in range(subspaces):
        found = lloyd(rest[:, s], codes)
        books[s, : len(found)] = found
        books[s, len(found) :] = found[0]
    nprobe, candidates = _tune(x, centroids, books, recall)
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            of, code = encode(x, centroids, books)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(of.astype(np.int32))], [key, "code", "list"])

    coded = spread(some.select(key, vector)).mapInArrow(run, f"`{key}` {kind}, code binary, list int")
    coded.repartition("list", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("list").parquet(f"{path}/lists")
    rows = [("centroid", k, c.tolist()) for k, c in enumerate(centroids)] + [("book", s * codes + c, books[s, c].tolist()) for s in range(subspaces) for c in range(codes)]
    rows.append(("search", 0, [float(nprobe), float(candidates)]))
    spark.createDataFrame(rows, "kind string, id int, vector array<double>").coalesce(1).write.parquet(f"{path}/model")
    return Index(path, key, vector, centroids, books, nprobe, candidates)


def encode(x: np.ndarray, centroids: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list and the code of each row."""
    of = nearest(x, centroids)[:, 0]
    rest = (x - centroids[of]).reshape(len(x), len(books), -1)
    return of, np.stack([nearest(rest[:, s], books[s])[:, 0] for s in range(len(books))], axis=1).astype(np.uint8)


def distances(q: np.ndarray, centroid: np.ndarray, books: np.ndarray, code: np.ndarray) -> np.ndarray:
    """About how far the coded rows of one list are from a query: a table for the query's residual, and a look-up a subspace."""
    rest = (q - centroid).reshape(len(books), 1, -1)
    return ((books - rest) ** 2).sum(2)[np.arange(len(books)), code].sum(1)


def _tune(x: np.ndarray, centroids: np.ndarray, books: np.ndarray, recall: float, k: int = 10, queries: int = 200) -> tuple[int, int]:
    """The least nprobe whose lists hold the root of ``recall`` of the k nearest rows of the sample, then the least power of two of candidates that finds ``recall``."""
    q, (of, code) = x[:queries], encode(x, centroids, books)
    top = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    order = nearest(q, centroids, len(centroids))
    place = np.argsort(order, axis=1)  # of each list among a query's lists
    at = np.take_along_axis(place, of[top], axis=1)
    nprobe = int(np.clip(np.sort(at, axis=None)[min(at.size - 1, int(np.ceil(recall**0.5 * at.size)))] + 1, 1, len(centroids)))
    places = []
    for i in range(len(q)):
        rows = np.flatnonzero(place[i, of] < nprobe)
        about = np.concatenate([distances(q[i], centroids[c], books, code[rows[of[rows] == c]]) for c in order[i, :nprobe]])
        rows = np.concatenate([rows[of[rows] == c] for c in order[i, :nprobe]])
        rank = np.full(len(x), len(x))
        rank[rows[np.argsort(about, kind="stable")]] = np.arange(len(rows))
        places.append(rank[top[i]])
    need = np.sort(np.concatenate(places))[min(at.size - 1, int(np.ceil(recall * at.size)) - 1)]
    return nprobe, 1 << max(5, int(need).bit_length())


def open_index(spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding", subspaces: int = 8) -> Index:
    """An index that :func:`build` has written; the model is as small as its bounds."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "id").collect()
    centroids = np.array([r["vector"] for r in rows if r["kind"] == "centroid"])
    books = np.array([r["vector"] for r in rows if r["kind"] == "book"])
    nprobe, candidates = next(r["vector"] for r in rows if r["kind"] == "search")
    return Index(path, key, vector, centroids, books.reshape(subspaces, -1, books.shape[1]), int(nprobe), int(candidates))


def search(index: Index, vectors: DataFrame, queries: DataFrame, k: int = 10, nprobe: int | None = None, candidates: int | None = None, query_key: str = "query_id", query_vector: str = "query_embedding", block: int = 1000) -> DataFrame:
    """(query_key, key, distance, rank): about the k nearest rows of ``vectors`` (the indexed ones) for each query.

    ``block`` queries at a time go to the tasks that read their lists, and only those lists are read. Each task keeps the best ``candidates`` of a
    query, and so does the shuffle; these meet their vectors for the exact distance. With nprobe for all lists and candidates for all
    rows the result is exact. Queries without a vector find nothing.
    """
    nprobe, candidates = nprobe or index.nprobe, candidates or max(k, index.candidates)
    asked = queries.filter(F.col(query_vector).isNotNull()).select(query_key, query_vector)
    blocks = max(1, -(-asked.count() // block))
    spark, out = queries.sparkSession, None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            continue
        found = _search_block(spark, index, part, nprobe, candidates, query_key, dict(queries.dtypes)[query_key])
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"`{query_key}` {dict(queries.dtypes)[query_key]}, `{index.key}` {dict(vectors.dtypes)[index.key]}, distance double, rank int")
    best = top_k_per_group(out, [query_key], [F.col("about").asc(), F.col(index.key).asc()], candidates).select(query_key, index.key)
    exact = best.join(vectors.select(index.key, index.vector), index.key).join(asked, query_key)
    exact = exact.select(query_key, index.key, cosine_distance(index.vector, query_vector).alias("distance")).filter("distance is not null")
    return top_k_per_group(exact, [query_key], [F.col("distance").asc(), F.col(index.key).asc()], k)


def _search_block(spark: SparkSession, index: Index, part: pa.Table, nprobe: int, candidates: int, query_key: str, kind: str) -> DataFrame:
    ids, q = part.column(0).combine_chunks(), _matrix(part.column(1).combine_chunks())
    probes = nearest(q, index.centroids, nprobe)
    wanted = {int(c): np.flatnonzero((probes == c).any(1)) for c in np.unique(probes)}
    centroids, books = index.centroids, index.books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_numpy(zero_copy_only=False)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for c in np.unique(lists):
                rows = np.flatnonzero(lists == c)
                code = np.frombuffer(b"".join(batch.column(1).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
                for i in wanted[int(c)]:
                    about = distances(q[i], centroids[c], books, code)
                    # Rows come in any order: of equal ones those with the least keys must stay, so all that tie with the last kept one do.
                    keep = np.flatnonzero(about <= np.partition(about, candidates - 1)[candidates - 1]) if len(about) > candidates else np.arange(len(about))
                    found.append((np.full(len(keep), i), rows[keep], about[keep]))
            if found:
                of, rows, about = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), batch.column(0).take(pa.array(rows)), pa.array(about)], [query_key, index.key, "about"])

    table = spark.read.parquet(f"{index.path}/lists")
    read = table.filter(F.col("list").isin(sorted(wanted))).select(index.key, "code", "list")
    return read.mapInArrow(run, f"`{query_key}` {kind}, `{index.key}` {dict(table.dtypes)[index.key]}, about double")
