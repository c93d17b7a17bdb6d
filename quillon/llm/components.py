"""Connected components by alternating large-star and small-star steps, as joins and sums over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


#: With more edges, no join may send one side to the driver; up to so many, Spark chooses.
BROADCAST = 1 << 17


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long), in either direction, repeats and loops allowed -> node, component (the smallest node reached).

    Nodes without an edge to another node are not returned. Each half step keeps every component and draws nodes nearer to
    its smallest one; a step that leaves the edges as they are ends the loop. Smallest neighbours come from a combining
    aggregate and go back by a join that adaptive execution can split, so a node with many neighbours is no single task. What a
    broadcast would take of the driver's memory is bounded by rows, as the size of a file says little of it."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    state = None
    many = e.count()
    for _ in range(rounds):
        held = (lambda d: d.hint("merge")) if many > BROADCAST else (lambda d: d)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(held(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(held(low), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        new = materialize(small.where("a <> b").distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        discard(e)
        e = new
        if now == state or not now[0]:
            break
        state, many = now, now[0]
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = materialize(nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    discard(e)
    return out
