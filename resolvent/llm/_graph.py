"""Distributed union-find: the components of a graph given as a table of links.

Every round lets each vertex point at its smallest neighbour, follows pointers
once more and contracts the links, so that a link table shrinks by a constant
factor in expectation (ids are scrambled first, so an adversarial order of ids
does not make long chains).  All steps are joins and partial aggregations; what
joins on a vertex that very many rows point at is answered by a broadcast, so
such a vertex costs no task more than its share.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._skew import frequent, join_unique


def _scramble(c: Column) -> Column:
    """Two rounds of xorshift: a bijection of longs that needs no multiplication."""
    for _ in range(2):
        c = c.bitwiseXOR(F.shiftleft(c, 13))
        c = c.bitwiseXOR(F.shiftrightunsigned(c, 7))
        c = c.bitwiseXOR(F.shiftleft(c, 17))
    return c


def _local_forest(batches):
    """Per task, a spanning forest of its links: at most one row for each vertex."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(x, x)) != top:
            parent[x] = top
            x = p
        return top

    def flush():
        rows = [(root(v), v) for v in list(parent)]
        parent.clear()
        rows = [(a, b) for a, b in rows if a != b]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if x != y:
                lo, hi = (x, y) if x < y else (y, x)
                parent[hi] = lo
                parent.setdefault(lo, lo)
        if len(parent) > 200_000:  # bounded memory: later rounds join what this splits
            yield flush()
    yield flush()


def components(spark: SparkSession, links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component): for every vertex of ``links`` (a, b: long) the smallest id that links reach.

    Links may repeat, be given in either direction or join a vertex to itself
    (then it is a vertex of its own).  Rows with a null end are ignored.  An
    empty table gives an empty table.
    """
    scratch = scratch or Scratch(spark)
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    edges = links.select(_scramble(F.col("a")).alias("a"), _scramble(F.col("b")).alias("b"))
    vertices = links.select("a").union(links.select("b")).distinct().select(F.col("a").alias("id"), _scramble(F.col("a")).alias("v"))
    vertices = scratch.cut(vertices, "vertices")
    edges = scratch.cut(edges.where("a <> b").mapInArrow(_local_forest, "a long, b long").distinct(), "edges")
    labels: DataFrame | None = None  # v, r: the vertex v was contracted into r
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m"))
        least = scratch.cut(least, "least")
        hop = join_unique(least, least.toDF("m", "r"), ["m"], hot=frequent(least, ["m"], scratch)).select("v", "r")
        hop = scratch.cut(hop, "hop")
        to = hop.select("v", "r")
        # A forest's edges point at their roots, which may be few.
        moved = join_unique(edges, to.toDF("a", "ra"), ["a"], hot=frequent(edges, ["a"], scratch)).join(to.toDF("b", "rb"), "b").where("ra <> rb")
        moved = moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        after = scratch.cut(moved.mapInArrow(_local_forest, "a long, b long").distinct(), "edges")
        if labels is None:
            labels_after = hop
        else:
            labels_after = scratch.cut(
                join_unique(labels, to.toDF("r", "r2"), ["r"], "left", frequent(labels, ["r"], scratch)).select("v", F.coalesce("r2", "r").alias("r")), "labels"
            )
            scratch.forget(labels)
            scratch.forget(hop)
        scratch.forget(edges)
        scratch.forget(least)
        edges, labels = after, labels_after
    if labels is None:
        return vertices.select("id", F.col("id").alias("component"))
    rooted = scratch.cut(vertices.join(labels, "v", "left").select("id", F.coalesce("r", "v").alias("r")), "rooted")
    smallest = rooted.groupBy("r").agg(F.min("id").alias("component"))
    return join_unique(rooted, smallest, ["r"], hot=frequent(rooted, ["r"], scratch)).select("id", "component")
