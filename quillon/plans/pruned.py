"""Top-k plans that leave out postings by score bounds before they are scored together; the answers of exhaustive ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.index import Index
from ..operators.retrieval import contributions, top_k, units, weights

#: Bounds are sums of doubles: compared with this much to spare.
SLACK = 1 + 1e-9


def _bounded(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """weights() with `upper` (bounds of this and all lesser terms of the query), `whole` (of all its terms) and `theta`: the k-th
    best score, in units, that the term with the highest bound gives alone, 0 if fewer documents have it.

    Only the lists of these terms are read for that. Rows are one for each term of a query."""
    by = Window.partitionBy("query_id").orderBy("bound", "term")
    w = weights(index, queries).withColumn("upper", F.sum("bound").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    w = w.withColumn("whole", F.max("upper").over(Window.partitionBy("query_id")))
    lead = w.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), F.desc("term")))).where("r = 1").drop("r")
    order = Window.partitionBy("query_id").orderBy(F.desc("units"), "doc_id")
    theta = contributions(index, lead).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).where(F.col("r") == k).select("query_id", F.col("units").alias("theta"))
    return w.join(theta, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(0)))


def _promising(index: Index, w: DataFrame) -> DataFrame:
    """Postings whose own score and the bounds of the query's other terms reach theta. A document that reaches it keeps all of its
    postings; one that loses some stays under it."""
    return contributions(index, w).where(F.col("units") + units((F.col("whole") - F.col("bound")) * SLACK) + 8 >= F.col("theta"))


def wand(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """A posting goes on only if its document could reach the threshold; checked where it is read, before any exchange."""
    return top_k(_promising(index, _bounded(index, queries, k)).groupBy("query_id", "doc_id").agg(F.sum("units").alias("units")), k)


def maxscore(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Besides, terms whose bounds together stay under the threshold make no candidates: a document needs one of the others."""
    p = _promising(index, _bounded(index, queries, k)).withColumn("needed", units(F.col("upper") * SLACK) + 8 >= F.col("theta"))
    p = p.groupBy("query_id", "doc_id").agg(F.sum("units").alias("units"), F.max("needed").alias("needed"))
    return top_k(p.where("needed"), k)
