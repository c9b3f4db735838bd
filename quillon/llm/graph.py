"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


#: Neighbours from which a node counts as a hub, and the share of all edges that bounds the number of hubs: at most 2 * SHARE of them are broadcast.
HUB, SHARE = 500, 500_000


def _with_least(edges: DataFrame, hub: int) -> DataFrame:
    """edges (u, v) with m, the least v of u. Edges of hubs, which are few by definition, are dealt over several keys."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.ceil(F.count("*") / hub).cast("int").alias("many"))
    hubs = least.where("many > 1").select("u", "many")
    dealt = edges.join(F.broadcast(hubs), "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("many", F.lit(1))).cast("int").alias("part"))
    return dealt.join(least.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("part")), ["u", "part"]).select("u", "v", "m")


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # The greater neighbours of u move to the least of u and its neighbours.
    return _with_least(both, hub).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    return _with_least(down, hub).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of `edges` (u, v: long) and the smallest node it reaches.

    The minimum per node is a partial aggregate, so a hub costs no more than any
    other key; on the way back a hub's edges are dealt over several keys. Steps
    repeat until the edge set, counted and hashed on the executors, stands still.
    """
    now, was = stored(edges.select("u", "v").where("u <> v").distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was or state[0] == 0:
            break
        was = state
        hub = max(HUB, state[0] // SHARE)
        now = stored(_small_star(_large_star(now, hub).distinct(), hub).distinct(), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
