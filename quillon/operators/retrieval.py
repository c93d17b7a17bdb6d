"""Boolean and BM25-ranked queries over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bm25 import query_term_weight
from ..functions.text import stem
from .index import Index

#: The stated query set: repeated, unknown and no terms, frequent and rare ones, four languages.
QUERIES = ["the and", "the the of", "of thing ing", "der die und", "la de que", "el es que", "loser", "idiot stupid", "on in at er", "tion ed", "zzunknownqq", "", "the zzunknownqq", "un une les", "ein eine nicht", "license", "a", "er er er", "was for with that this is it to", "thing nd thth", "den das ist", "Thing  THE", "worthless trash"]


def query_table(spark: SparkSession, queries: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUERIES if queries is None else queries)), "query_id long, text string")


def _numbered(lines: DataFrame) -> DataFrame:
    """lines (value, f, at) -> n, value: lines in order of files and places in them, numbered from 0. `at` goes up in a file in
    runs of 2^33 for each partition; runs are counted first, so lines are numbered run by run, not in one task."""
    lines = lines.withColumn("run", F.shiftright("at", 33))
    runs = lines.groupBy("f", "run").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("f", "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each run
    inside = F.row_number().over(Window.partitionBy("f", "run").orderBy("at")) - 1
    return lines.join(runs.select("f", "run", before.alias("before")), ["f", "run"]).select((F.col("before") + inside).cast("long").alias("n"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """n (from 0), value: the lines of text files in order."""
    d = spark.read.text(path)
    return _numbered(d.select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text: raw queries, one a line; lines without a word are no queries and have no number."""
    d = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at"))
    some = F.size(F.filter(F.split("value", " "), lambda x: x != "")) > 0
    return _numbered(d.where(some)).select(F.col("n").alias("query_id"), F.col("value").alias("text"))


def read_id_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, terms: queries of term ids, one a line between white space; blank lines are empty queries, and a line ends at
    the first word that is no whole number of 32 bits."""
    words = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    ids = F.transform(words, lambda x: F.when(x.rlike(r"^[+]?[0-9]{1,10}$"), x.cast("long")))
    ids = F.transform(ids, lambda x: F.when(x < 1 << 32, x))
    bad = F.array_position(F.transform(ids, lambda x: x.isNull()), True)
    return read_lines(spark, path).select(F.col("n").alias("query_id"), F.when(bad > 0, F.slice(ids, F.lit(1), (bad - 1).cast("int"))).otherwise(ids).alias("terms"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, pos, token: split at single spaces, lower-cased, empty ones dropped."""
    t = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    return queries.select("query_id", F.posexplode(t).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf."""
    return query_tokens(queries).groupBy("query_id", F.col("token").alias("term")).agg(F.count("*").alias("qtf"))


def map_queries(queries: DataFrame, vocabulary: DataFrame, stemmed: DataFrame | None = None) -> DataFrame:
    """query_id, pos, term_id, and stem_id where a dictionary of stems is given.

    Words are sought as they are in vocabulary (term_id, term), their stems in `stemmed`. A word with an empty stem is left out;
    a query with a word that either dictionary lacks is left out whole. Of equal terms the last one's id counts."""
    t = query_tokens(queries)
    found = F.lit(True)
    if stemmed is not None:
        s = stemmed.groupBy(F.col("term").alias("stem")).agg(F.max("term_id").alias("stem_id"))
        t = t.withColumn("stem", stem("token")).where("stem <> ''").join(s, "stem", "left")
        found = F.col("stem_id").isNotNull()
    v = vocabulary.groupBy("term").agg(F.max("term_id").alias("term_id"))
    t = t.join(v, t["token"] == v["term"], "left").withColumn("found", found & F.col("term_id").isNotNull())
    whole = t.groupBy("query_id").agg(F.bool_and("found").alias("whole")).where("whole").select("query_id")
    return t.join(whole, "query_id", "left_semi").select("query_id", "pos", "term_id", *(["stem_id"] if stemmed is not None else []))


#: Terms of a query set up to this number are sought by a filter that reaches the scan, more by a join.
FILTERED = 1000
#: Scores are summed as whole numbers of this unit, so no order of summing changes a rank.
UNIT = 1e12


def _of_terms(table: DataFrame, q: DataFrame) -> DataFrame:
    """Rows of a table that have a term of q (query_id, term, ...)."""
    terms = q.select("term").distinct()
    some = [r["term"] for r in terms.limit(FILTERED + 1).collect()]
    return table.where(F.col("term").isin(some)) if len(some) <= FILTERED else table.join(terms, "term", "left_semi")


def boolean(index: Index, queries: DataFrame, every: bool, freqs: bool) -> DataFrame:
    """query_id, results, and freq_sum: documents with all or any of the distinct terms. No term: 0. Unknown term: no document."""
    q = query_terms(queries)
    need = q.groupBy("query_id").agg(F.count("*").alias("terms"))
    m = q.join(_of_terms(index.postings, q), "term")
    hits = m.groupBy("query_id", "doc_id").agg(F.count("*").alias("found"), F.sum("freq").alias("freq"))
    if every:
        hits = hits.join(need, "query_id").where("found = terms")
    counts = hits.groupBy("query_id").agg(F.count("*").alias("results"), F.sum("freq").alias("freq_sum"))
    out = queries.select("query_id").join(counts, "query_id", "left").fillna(0, ["results", "freq_sum"])
    return out if freqs else out.drop("freq_sum")


def weights(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, term, qtf, df, q_w (the query's part of the term's score), bound (the most that the term adds anywhere)."""
    q = query_terms(queries)
    n = (index.collection.first() or [0])[0]
    stats = _of_terms(index.term_stats, q).select("term", "df", "max_term_weight")
    q_w = query_term_weight(F.col("qtf"), F.col("df"), F.lit(n))
    return q.join(stats, "term").select("query_id", "term", "qtf", "df", q_w.alias("q_w"), (q_w * F.col("max_term_weight")).alias("bound"))


def units(score: Column) -> Column:
    return F.floor(score * F.lit(UNIT) + F.lit(0.5)).cast("long")


def contributions(index: Index, w: DataFrame) -> DataFrame:
    """All columns of weights() but qtf and df, with doc_id and units: what each term adds."""
    p = _of_terms(index.postings, w).select("term", "doc_id", "d_w")
    return w.drop("qtf", "df").join(p, "term").withColumn("units", units(F.col("q_w") * F.col("d_w"))).drop("d_w")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """scored (query_id, doc_id, units) -> query_id, rank, doc_id, score: by score, then doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("units"), "doc_id")
    d = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return d.select("query_id", F.col("rank").cast("long"), "doc_id", F.round(F.col("units") / F.lit(UNIT), 9).alias("score"))


def ranked(index: Index, queries: DataFrame, every: bool = False, k: int = 10) -> DataFrame:
    """Top k documents by BM25 of any term, or of all distinct terms."""
    c = contributions(index, weights(index, queries)).groupBy("query_id", "doc_id").agg(F.sum("units").alias("units"), F.count("*").alias("found"))
    if every:
        need = query_terms(queries).groupBy("query_id").agg(F.count("*").alias("terms"))
        c = c.join(need, "query_id").where("found = terms")
    return top_k(c, k)
