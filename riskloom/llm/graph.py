"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.staging import passing, stage

#: Edges that a task draws together at once.
DRAWN = 1 << 16


def _stars(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, least node reachable by ``edges``) of every other node."""
    above: dict[int, int] = {}

    def least(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for hi, lo in edges:
        x, y = least(hi), least(lo)
        if x != y:
            above[max(x, y)] = min(x, y)
    return [(x, least(x)) for x in list(above)]


def drawn_together(edges: DataFrame, drawn: int = DRAWN, whole: bool = False) -> DataFrame:
    """``hi``, ``lo``: fewer edges that join the same nodes. Each ``drawn`` edges of a task become stars, with an edge to itself for a star's least node if ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []

        def stars(part: list[tuple[int, int]]) -> pa.RecordBatch:
            found = _stars(part)
            if whole:
                found += [(x, x) for x in {lo for _, lo in found}]
            columns = list(zip(*found)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["hi", "lo"])

        for batch in batches:
            held += zip(batch.column("hi").to_pylist(), batch.column("lo").to_pylist())
            while len(held) >= drawn:
                yield stars(held[:drawn])
                del held[:drawn]
        yield stars(held)

    return edges.select("hi", "lo").mapInArrow(run, "hi bigint, lo bigint")


def components(edges: DataFrame, drawn: int = DRAWN) -> DataFrame:
    """``node`` and ``component`` (its least reachable node) of every node in ``edges`` (``a``, ``b``; read twice).

    Alternating stars: each node hands its larger neighbours to its least one, then its
    smaller ones likewise, until every node points at its component's least node. Each
    half round is a minimum per node and a join; the minima are written first, so that the
    join sees two plain shuffles and a node with very many edges can be split. Before the
    rounds every task draws the edges it has together, some at a time, which leaves few rounds to do. Tasks are
    as many as there are such portions, however many partitions the edges come in; of one portion nothing is left to do.
    """
    spark = edges.sparkSession
    known = edges.where("a is not null and b is not null and a <> b")
    known = known.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    portions = -(-known.count() // drawn)
    if portions <= 1:
        return stage(drawn_together(known.coalesce(1), drawn + 1, whole=True).toDF("node", "component"), "components")
    with passing(spark) as keep:
        current = stage(known.distinct(), "edges")
        current = stage(drawn_together(current.coalesce(portions), drawn).distinct(), "edges")
        while not _settled(current):
            with passing(spark) as hand_on:
                both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(current.select("lo", "hi"))
                least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
                larger = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "edges")
                floor = stage(larger.groupBy("hi").agg(F.min("lo").alias("m")), "least")
                smaller = larger.join(floor, "hi").select(
                    F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")
                )
                current = hand_on(smaller.distinct(), "edges")
        roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
        return keep(current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots), "components")


def _settled(edges: DataFrame) -> bool:
    """Whether each node is either the least one of a star or has one edge, to a star's least node."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("below")).union(edges.select("lo", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("edges"), F.min("below").alias("least"))
    return nodes.where("edges > 1 or (edges = 1 and least = 0)").isEmpty()
