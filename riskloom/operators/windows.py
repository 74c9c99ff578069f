"""Window aggregates over whole groups that stay safe when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.numeric import guarded_ratio
from riskloom.operators.features import PEER_GROUP
from riskloom.sources.staging import stage

# What each kind needs from a piece of a group, and how pieces are put together.
KINDS = {
    "sum": (("sum",), lambda w, c: F.sum(c["sum"]).over(w)),
    "count": (("count",), lambda w, c: F.sum(c["count"]).over(w)),
    "min": (("min",), lambda w, c: F.min(c["min"]).over(w)),
    "max": (("max",), lambda w, c: F.max(c["max"]).over(w)),
    "avg": (("sum", "count"), lambda w, c: F.sum(c["sum"]).over(w) / F.nullif(F.sum(c["count"]).over(w), F.lit(0))),
}
PARTIAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def over_groups(df: DataFrame, by: Sequence[str], columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``columns`` (name: (kind, column)), each the aggregate ``over (partition by …)``.

    A plain window sends a group to one task. Here a group is cut into the pieces that the tasks
    hold, each piece is summed up where it is, and the window runs over these sums: as many rows
    per group as there are tasks. Rows get the result of their own (group, piece), so a group
    of any size is joined piece by piece. A null in ``by`` is a group, as in a window.
    """
    rows = stage(df.withColumn("_piece", F.spark_partition_id()), "pieces")
    needed = sorted({(part, c) for kind, c in columns.values() for part in KINDS[kind][0]})
    named = {pair: f"_s{i}" for i, pair in enumerate(needed)}
    sums = rows.groupBy(*by, "_piece").agg(*[PARTIAL[part](F.col(c).cast("double") if part == "sum" else c).alias(n) for (part, c), n in named.items()])
    window = Window.partitionBy(*by)

    def total(kind: str, column: str) -> Column:
        return KINDS[kind][1](window, {part: F.col(named[part, column]) for part in KINDS[kind][0]})

    made = sums.select(*by, "_piece", *[total(kind, c).alias(name) for name, (kind, c) in columns.items()])
    totals = stage(made, "group-totals")
    same = rows["_piece"] == totals["_piece"]
    for c in by:
        same &= rows[c].eqNullSafe(totals[c])
    return rows.join(totals, same).select(*[rows[c] for c in df.columns], *[totals[c] for c in columns])


def peer_comparison(level: DataFrame) -> DataFrame:
    """Peer mean and deviation score by a window over the peer group, instead of a join with a table of means.

    Unlike there, prescribers without a peer group are each other's peers.
    """
    compared = over_groups(level, [PEER_GROUP], {"peer_avg_payment": ("avg", "avg_payment_amount")})
    return compared.withColumn("peer_deviation_score", guarded_ratio(F.col("avg_payment_amount"), F.col("peer_avg_payment")))
