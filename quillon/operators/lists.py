"""Members of linked lists in triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.inference import RDF
from quillon.sources.shared import stored

FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"


def list_members(triples: DataFrame, rounds: int = 40) -> DataFrame:
    """list, index (from 0), member of every list, named by its head: a node with a first element that is no node's rest.

    Each node points to the node before it; pointers double in each round until
    all reach a head, so a list of n nodes takes log2 n rounds and n rows. A
    round is written to the shared folder. Raises on cycles.
    """
    of = lambda p: triples.where((F.col("p") == p) & F.col("s").isNotNull() & F.col("o").isNotNull()).select("s", "o").distinct()
    nodes = of(FIRST).toDF("node", "member")
    before = of(REST).where(F.col("o") != NIL).select(F.col("o").alias("node"), F.col("s").alias("up"))
    known = nodes.select("node").distinct().join(before, "node", "left")
    at = known.select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("far"))
    for _ in range(rounds):
        at = stored(at, "lists")
        if at.where("far > 0").select(F.col("up").alias("node")).distinct().join(at.where("far > 0"), "node", "left_semi").isEmpty():
            return at.join(nodes, "node").select(F.col("up").alias("list"), F.col("far").alias("index"), "member")
        there = at.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("far").alias("__far"))
        at = at.join(there, "up", "left").select("node", F.coalesce("__up", "up").alias("up"), (F.col("far") + F.coalesce("__far", F.lit(0))).alias("far"))
    raise RuntimeError(f"lists did not settle in {rounds} rounds: a cycle?")


def list_lengths(triples: DataFrame) -> DataFrame:
    """list, length of every list that has members."""
    return list_members(triples).groupBy("list").agg((F.max("index") + 1).alias("length"))
