"""Connected components by alternating large-star and small-star rounds.

Each round is a pre-aggregated minimum by vertex and one equi-join.  The few
vertices that hold a large share of all edges take their minimum from a
broadcast, so no task gathers the edges of one vertex.  Rounds are written to
the shared folder; nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A vertex with more than this share of the directed edges is heavy; there are fewer than HEAVY such vertices.
HEAVY = 500


def _signature(e: DataFrame) -> tuple[int, int | None]:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, total: int, least) -> DataFrame:
    """(u, v) -> (u, v, m): m is ``least`` of u's edges; heavy vertices by broadcast."""
    m = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", least, "n")
    heavy = F.broadcast(m.where(F.col("n") > max(total // HEAVY, 64)).select("u", "m"))
    light = edges.join(heavy, "u", "left_anti").join(m.where(F.col("n") <= max(total // HEAVY, 64)).select("u", "m"), "u")
    return edges.join(heavy, "u").unionByName(light)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) pairs of longs -> (id, component): smallest id reachable.

    Only vertices with at least one edge to another vertex are returned.  Null
    ends and loops are ignored; repeated and reversed pairs count once.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _signature(e)  # stars, and no edges at all, stay as they are
    for _ in range(max_rounds if state[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both, 2 * state[0], F.least("u", "m").alias("m"))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
        )
        large = scratch.store(large, "large")
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        small = _with_least(large, state[0], F.col("m")).select(ends.alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = scratch.store(small, "edges")
        scratch.drop_others(e)
        now = _signature(e)
        if state == now:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
