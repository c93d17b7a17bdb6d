"""Postings and statistics of a document collection."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bm25 import doc_term_weight
from ..functions.text import tokens


def postings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> term, doc_id, freq, doc_len."""
    d = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    d = d.select("doc_id", F.size("t").cast("long").alias("doc_len"), F.explode("t").alias("term"))
    return d.groupBy("term", "doc_id", "doc_len").agg(F.count("*").alias("freq"))


def lexicon(docs: DataFrame) -> DataFrame:
    """term_id from 0 in the order of terms, and term. Terms are numbered within their first three characters; the numbers
    where these start come from a small running sum, so no task sorts the whole lexicon."""
    t = docs.select(F.explode(tokens(F.col("text"))).alias("term")).distinct().withColumn("head", F.substring("term", 1, 3))
    heads = t.groupBy("head").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1))  # at most 37^3 rows
    heads = heads.select("head", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("head").orderBy("term")) - 1
    return t.join(heads, "head").select((F.col("before") + inside).cast("long").alias("term_id"), "term")


def collection_stats(docs: DataFrame) -> DataFrame:
    """One row: num_docs, num_tokens, avg_len."""
    n = F.size(tokens(F.col("text"))).cast("long")
    return docs.agg(F.count("*").alias("num_docs"), F.coalesce(F.sum(n), F.lit(0)).alias("num_tokens")).withColumn("avg_len", F.try_divide(F.col("num_tokens").cast("double"), F.col("num_docs")))


def doc_stats(docs: DataFrame) -> DataFrame:
    """doc_id, doc_len, norm_len: the length against the mean."""
    d = docs.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("doc_len"))
    return d.crossJoin(collection_stats(docs).select("avg_len")).select("doc_id", "doc_len", F.try_divide(F.col("doc_len").cast("double"), F.col("avg_len")).alias("norm_len"))  # one row on the right


def weighted_postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, freq, d_w: the document's part of a term's score. The two numbers of the collection are counted first."""
    n, _, avg = collection_stats(docs).first()
    return postings(docs).select("term", "doc_id", "freq", doc_term_weight(F.col("freq"), F.col("doc_len") / F.lit(avg or 1.0)).alias("d_w"))


def term_stats(weighted: DataFrame) -> DataFrame:
    """weighted_postings() -> term, df, cf, max_term_weight."""
    return weighted.groupBy("term").agg(F.count("*").alias("df"), F.sum("freq").alias("cf"), F.max("d_w").alias("max_term_weight"))


@dataclass
class Index:
    """What queries are answered from: postings (term, doc_id, freq, d_w), doc_stats, term_stats with the bounds for pruning, and
    collection (one row: num_docs, num_tokens, avg_len)."""

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    collection: DataFrame

    @classmethod
    def of(cls, docs: DataFrame) -> Index:
        """Of documents as they are, nothing stored."""
        p = weighted_postings(docs)
        return cls(p, doc_stats(docs), term_stats(p), collection_stats(docs))

    @classmethod
    def open(cls, spark: SparkSession, path: str, warm: bool = False) -> Index:
        """Of a stored index; warm keeps its tables in memory."""
        got = [spark.read.parquet(f"{path}/{name}") for name in ("postings", "doc_stats", "term_stats", "collection")]
        return cls(*[d.cache() if warm else d for d in got])

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> Index:
        """Store the index of docs and open it. Postings lie in the order of terms, so a query reads the row groups of its terms;
        long lists go over several files."""
        spark = docs.sparkSession
        weighted_postings(docs).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        doc_stats(docs).write.mode("overwrite").parquet(f"{path}/doc_stats")
        term_stats(spark.read.parquet(f"{path}/postings")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")
        collection_stats(docs).write.mode("overwrite").parquet(f"{path}/collection")
        return cls.open(spark, path)


_STORED: dict[tuple[str, str], str] = {}


def stored(docs: DataFrame, name: str) -> Index:
    """The index of docs, stored in the warehouse once in a session under this name and deleted when the driver's JVM ends."""
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quillon-index-{uuid.uuid4().hex}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
        Index.build(docs, path)
        _STORED[key] = path
    return Index.open(spark, _STORED[key])


def supplier_lists(lineitem: DataFrame) -> DataFrame:
    """Posting lists from orders by supplier: term_id, doc_id, freq; and num_docs, one over the largest doc_id."""
    p = lineitem.groupBy(F.col("l_suppkey").alias("term_id"), F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("freq"))
    return p.crossJoin(lineitem.agg((F.max("l_orderkey") + 1).alias("num_docs")))  # one row on the right


def positioned(lists: DataFrame) -> DataFrame:
    """Postings with position (from 0), size of the list, previous doc_id (-1 at first) and gap."""
    by_doc = Window.partitionBy("term_id").orderBy("doc_id")
    d = lists.withColumn("position", F.row_number().over(by_doc).cast("long") - 1).withColumn("before", F.lag("doc_id", 1, -1).over(by_doc))
    return d.withColumn("size", F.count("*").over(Window.partitionBy("term_id"))).withColumn("gap", F.col("doc_id") - F.col("before") - 1)


def verify(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: how many postings each side has that the other lacks."""
    a, b = one.select("term", "doc_id", "freq"), other.select("term", "doc_id", "freq")
    return a.exceptAll(b).agg(F.count("*").alias("missing")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("extra")))
