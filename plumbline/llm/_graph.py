"""Connected components of a graph of any size, by contraction over random ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._storage import cut


def contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round: ``(v, m)`` for every vertex of ``edges`` (``a``, ``b``), and the edges that are left between the ``m``.

    ``m`` is the vertex of least rank within two steps of ``v``; ranks are hashes that differ from turn to turn.  So a
    star becomes one vertex, and of a chain about a third of the vertices is left, however its vertices are numbered.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = lambda v: F.struct(F.xxhash64(v, F.lit(turn)).alias("h"), F.col(v).alias("m"))
    near = both.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a"))).alias("near"))
    # a neighbour's nearest covers all that is within two steps, the vertex itself included
    within_two = both.join(near.toDF("b", "near"), "b").groupBy(F.col("a").alias("v")).agg(F.min("near").alias("k"))
    step = cut(within_two.select("v", F.col("k.m").alias("m")))
    left = (
        edges.join(step.toDF("a", "ma"), "a")
        .join(step.toDF("b", "mb"), "b")
        .where(F.col("ma") != F.col("mb"))
        .select(F.greatest("ma", "mb").alias("a"), F.least("ma", "mb").alias("b"))
        .distinct()
    )
    return step, cut(left)


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges`` (``a``, ``b``); a component is named by its least vertex.

    Edges with a null end, and edges of a vertex with itself, are ignored.  Every round leaves a fraction of the
    vertices, so the rounds grow with the logarithm of their number; what the rounds mapped is put together from the
    last, smallest one backwards.  All joins are between checkpointed tables, so a vertex with very many edges is a
    skewed join that adaptive execution can split; least ranks combine before the shuffle.
    """
    edges = cut(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    steps = []
    while not edges.isEmpty():
        step, edges = contract(edges, len(steps))
        steps.append(step)
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = steps.pop()
    for step in reversed(steps):
        above = roots.toDF("m", "root")
        roots = cut(step.join(above, "m", "left").select("v", F.coalesce("root", "m").alias("m")))
    names = roots.groupBy("m").agg(F.min("v").alias("component"))
    # dealt by vertex again, so that the rows of a large component do not stay in one partition
    return cut(roots.join(names, "m").select(F.col("v").alias("id"), "component").repartition("id"))
