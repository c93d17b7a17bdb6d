"""Queries of the retrieval engine by name, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits
from .functions.bm25 import query_term_weight
from .functions.codecs import BLOCK_CODECS
from .functions.sequences import INDEX_TYPES
from .functions.text import stem
from .operators import coding, index, layout, retrieval
from .oracles import oracle_sql  # noqa: F401
from .plans import pruned
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _docs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def _lists(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(index.supplier_lists(table(spark, sf_dir, "lineitem")))


def _ask(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"), retrieval.query_table(spark))


def _search(f: Callable[[index.Index, DataFrame], DataFrame]) -> Query:
    """Over the stored index of documents, which the first such query of a session builds."""
    return lambda spark, sf_dir: f(index.stored(table(spark, sf_dir, "documents"), sf_dir), retrieval.query_table(spark))


def _numbers(f: Callable[[DataFrame], DataFrame]) -> Query:
    """Over x: quantities, prices and keys of lineitem as whole numbers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = table(spark, sf_dir, "lineitem")
        return f(one.select(F.explode(F.array(F.col("l_orderkey"), F.col("l_partkey"), (F.col("l_extendedprice") * 100).cast("long"), (F.col("l_extendedprice") * 10000).cast("long"))).alias("x")).distinct().where("x >= 0"))

    return run


def _bm25_weights(i: index.Index, queries: DataFrame) -> DataFrame:
    return retrieval.weights(i, queries).select("query_id", "term", "qtf", "df", F.round("q_w", 9).alias("weight"))


def _query_map(docs: DataFrame, queries: DataFrame) -> DataFrame:
    return retrieval.map_queries(queries, index.lexicon(docs))


def _query_lines(docs: DataFrame, queries: DataFrame) -> DataFrame:
    m = _query_map(docs, queries).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term_id"))).alias("x"))  # terms of one query
    return m.select("query_id", F.concat_ws("\t", F.transform("x", lambda x: x["term_id"].cast("string"))).alias("line"))


def _skipped(docs: DataFrame, queries: DataFrame) -> DataFrame:
    done = _query_map(docs, queries).select("query_id").distinct().withColumn("mapped", F.lit(1))
    asked = retrieval.query_tokens(queries).select("query_id").distinct()
    return asked.join(done, "query_id", "left").agg(F.count("*").alias("asked"), F.count("mapped").alias("mapped"), F.count_if(F.col("mapped").isNull()).alias("skipped"))


def _stemmed(docs: DataFrame) -> DataFrame:
    return index.lexicon(docs).select("term").withColumn("stem", stem("term"))


def _list_view(lists: DataFrame) -> DataFrame:
    return layout.list_sizes(lists).select("term_id", "n", "first", "last", "occurrences")


def _accessors(lists: DataFrame) -> DataFrame:
    return index.positioned(lists).select("term_id", "doc_id", "freq", "position", "size")


def _verify(docs: DataFrame, i: index.Index) -> DataFrame:
    """Postings of the stored index against those of the documents: lacking and additional ones, how many there are, and a checksum."""
    d = index.verify(index.postings(docs), i.postings)
    sums = i.postings.agg(F.count("*").alias("postings"), F.sum(F.col("freq") * (F.col("doc_id") + 1) * F.length("term")).alias("checksum"))
    return d.crossJoin(sums)  # one row on either side


def _stats_line(lists: DataFrame) -> DataFrame:
    d = layout.block_size_stats(lists)
    return d.select(F.to_json(F.struct(F.col("class").alias("type"), "blocks", "postings", "overhead_bytes", "vbyte_doc_bytes", "vbyte_freq_bytes")).alias("line"))


def _packed_models(lists: DataFrame) -> DataFrame:
    models, _ = coding.ans_models(lists, "max", merge=False, packed=True)
    rows = [(s, int(m), k, int(f)) for s, by in models.items() for m, x in by.items() for k, f in enumerate(x.freq.tolist()) if f]
    return lists.sparkSession.createDataFrame(rows, "stream string, model_id long, mag long, frequency long")


_QUERIES: dict[str, Query] = {
    "postings": _docs(lambda d: index.postings(d).select("term", "doc_id", "freq")),
    "lexicon": _docs(index.lexicon),
    "collection_stats": _docs(lambda d: index.collection_stats(d).withColumn("avg_len", F.round("avg_len", 9))),
    "doc_stats": _docs(lambda d: index.doc_stats(d).withColumn("norm_len", F.round("norm_len", 9))),
    "term_stats": _docs(lambda d: index.term_stats(index.weighted_postings(d)).withColumn("max_term_weight", F.round("max_term_weight", 9))),
    "verify_postings": lambda spark, sf_dir: _verify(table(spark, sf_dir, "documents"), index.stored(table(spark, sf_dir, "documents"), sf_dir)),
    "stemmed_terms": _docs(_stemmed),
    "query_tokens": lambda spark, _: retrieval.query_tokens(retrieval.query_table(spark)),
    "query_terms": lambda spark, _: retrieval.query_terms(retrieval.query_table(spark)),
    "query_map": _ask(_query_map),
    "query_lines": _ask(_query_lines),
    "query_skipped": _ask(_skipped),
    "bm25_weights": _search(_bm25_weights),
    "and_count": _search(lambda d, q: retrieval.boolean(d, q, True, False)),
    "and_freq": _search(lambda d, q: retrieval.boolean(d, q, True, True)),
    "or_count": _search(lambda d, q: retrieval.boolean(d, q, False, False)),
    "or_freq": _search(lambda d, q: retrieval.boolean(d, q, False, True)),
    "ranked_or": _search(retrieval.ranked),
    "ranked_and": _search(lambda d, q: retrieval.ranked(d, q, every=True)),
    "wand": _search(pruned.wand),
    "maxscore": _search(pruned.maxscore),
    "list_view": _lists(_list_view),
    "cursor_accessors": _lists(_accessors),
    "next_posting": _lists(layout.next_posting),
    "next_geq": _lists(layout.next_geq),
    "move_to": _lists(layout.move_to),
    "prev_value": _lists(layout.prev_value),
    "freq_prefix_sum": _lists(layout.freq_prefix_sums),
    "positive_decode": _lists(layout.positive_decode),
    "block_layout": _lists(layout.block_layout),
    "block_bytes": _lists(layout.block_bytes),
    "block_size_stats": _lists(layout.block_size_stats),
    "ans_block_size_stats": _lists(coding.ans_block_size_stats),
    "packed_block_size_stats": _lists(lambda p: coding.ans_block_size_stats(p, context="max", merge=False, packed=True)),
    "ans_models": _lists(coding.model_tables),
    "index_size_stats": _lists(layout.index_size_stats),
    "stats_line": _lists(_stats_line),
    "sequence_sizes": _lists(layout.sequence_sizes),
    "uniform_partitions": _lists(layout.uniform_partitions),
    "uniform_partition_size": _lists(layout.uniform_partition_sizes),
    "endpoints": _lists(layout.endpoints),
    "code_sizes": _numbers(lambda d: d.select("x", bits.ceil_log2(F.col("x")).alias("log2"), bits.gamma_bits(F.col("x")).alias("gamma"), bits.delta_bits(F.col("x")).alias("delta"), bits.vbyte_bytes(F.col("x")).alias("vbyte"), bits.vbyte64_bytes(F.col("x")).alias("vbyte64"))),
    "symbols": _numbers(lambda d: d.where("x > 0").select("x", bits.magnitude(F.col("x")).alias("mag"), bits.selector(F.col("x")).alias("sel"), bits.msb_symbol(F.col("x")).alias("symbol"), bits.exception_bytes(F.col("x")).alias("exception_bytes"))),
    "contexts": _lists(layout.contexts),
    "ans_histogram": _lists(layout.symbol_counts),
    "packed_histogram": _lists(layout.magnitude_counts),
    "ans_entropy": _lists(layout.entropy),
    "ans_merged_models": _lists(coding.merged_models),
    "packed_models": _lists(_packed_models),
    "decode_stats": _lists(coding.decode_stats),
    "optimal_partitions": _lists(coding.optimal_partitions),
    "partition_lengths": _lists(coding.partition_lengths),
    "latency_quantiles": lambda spark, sf_dir: layout.quantiles(table(spark, sf_dir, "events").select("value")),
}
_QUERIES |= {f"verify_{c}": _lists(lambda p, c=c: coding.verify_blocks(p, c) if c in ("vbyte", "u32") else coding.verify_blocks(p, c).drop("bytes")) for c in BLOCK_CODECS}
_QUERIES |= {f"list_bits_{c}": _lists(lambda p, c=c: coding.list_bits(p, c)) for c in INDEX_TYPES}
_QUERIES |= {f"verify_ans_{c}": _lists(lambda p, c=c: coding.verify_ans(p, c, merge=c in ("med90p", "medmax")).drop("bytes")) for c in ("max", "minmax", "med90p", "medmax")}
_QUERIES |= {"verify_ans_packed": _lists(lambda p: coding.verify_ans(p, "max", merge=False, packed=True).drop("bytes"))}
_QUERIES |= {f"sizes_{c}": _lists(lambda p, c=c: coding.verify_blocks(p, c)) for c in ("simple16", "varint", "interpolative", "optpfor")}
_QUERIES |= {"sizes_ans": _lists(coding.verify_ans), "sizes_ans_packed": _lists(lambda p: coding.verify_ans(p, "max", merge=False, packed=True))}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
