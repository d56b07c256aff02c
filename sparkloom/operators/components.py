"""Connected components of an undirected graph by alternating star contraction.

Each round rewrites every edge towards the smallest neighbour: first around each node (large star), then among a node's
smaller neighbours (small star). Both steps need only a minimum per node, so a hub costs a partial aggregate and a
join row per edge, never a list. Rounds grow with the logarithm of the longest path; the edges of each round are written
to the shared folder, which keeps plans short and lets a lost executor repeat one round only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import materialize, materialize_observed, release


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("u is not null and v is not null and u <> v").distinct()


def large_star(edges: DataFrame, split: bool = False) -> DataFrame:
    """For each node, its larger neighbours point to the smallest of the node and its neighbours. split: see :func:`connected_components`."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = materialize(least, "least") if split else least
    return _clean(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def small_star(edges: DataFrame, split: bool = False) -> DataFrame:
    """For each node, the node itself and its smaller neighbours point to the smallest of these. split: see :func:`connected_components`."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    least = materialize(least, "least") if split else least
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _clean(moved.unionAll(least.select("u", F.col("m").alias("v"))))


def _write(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and the sum of their hashes."""
    hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    out, seen = materialize_observed(edges, "edges", n=F.count(F.lit(1)), s=hashes)
    return out, (seen["n"], seen["s"])


def _forest(edges: DataFrame, held: int = 0) -> DataFrame:
    """Each partition's edges as stars, by union-find: an edge from every node to the least that the partition's edges reach from it.

    With ``held``, a partition passes on what it has whenever it holds so many nodes, so memory is bounded and stars may still touch.
    """
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        schema = None

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        def stars() -> pa.RecordBatch:
            nodes = list(parent)
            return pa.RecordBatch.from_arrays([pa.array(nodes, schema), pa.array([root(x) for x in nodes], schema)], ["u", "v"])

        for batch in batches:
            schema = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if held and len(parent) > held:
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    return edges.mapInArrow(run, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60, one_task_rows: int = 0, split_hubs: bool = False) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another; ``component`` is the least node reachable.

    Nulls and self loops are ignored, repeated edges count once, and any orderable type will do for nodes. An empty edge
    table gives an empty result. Raises if ``max_rounds`` do not suffice, which paths of fewer than 2**60 nodes never reach.
    With ``one_task_rows`` Python helps: if there are no more than so many distinct edges, one task joins them, without the rounds'
    fixed cost; if there are more, partitions contract theirs to stars first. The result is the same.

    A hub's edges meet its minimum in one join key. With ``split_hubs`` the minima of each step are a table of their own, two small writes
    more a round, so that adaptive execution can deal a hub's edges to several tasks; an aggregate under the join keeps it from that.
    """
    now, mark = _write(_clean(edges.select(F.col(u).alias("u"), F.col(v).alias("v"))))
    if one_task_rows and mark[0] > one_task_rows:
        before = now
        now, mark = _write(_clean(_forest(before, one_task_rows)))
        release(before)
    if one_task_rows and mark[0] <= one_task_rows:
        found = materialize(_forest(now.coalesce(1)).select(F.col("u").alias("node"), F.col("v").alias("component")), "components")
        release(now)
        return found
    for _ in range(max_rounds):
        before, seen = now, mark
        now, mark = _write(small_star(large_star(before, split_hubs), split_hubs))
        release(before)
        if mark == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)


#: Edges that a task holds easily (some 100 bytes each), for callers that may use Python.
FEW_EDGES = 250_000
