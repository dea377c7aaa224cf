"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Edges (a, b) have a > b. Minima are aggregated, so no neighbourhood is ever gathered."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        moved = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(a, b) edges to (id, component): the smallest id reachable. Ids without an edge have no row.

    Self-loops and repeated edges change nothing; an empty table gives an empty one. Each step is written to
    the shared folder, so a lost executor costs one step. Both stars have run without a change when it ends.
    """
    now = ws.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        nxt = ws.save(_stars(_stars(now, True), False), "stars")
        new = _mark(nxt)
        ws.drop(now)
        now, same = nxt, new == mark
        mark = new
        if same:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
