"""Binary collections: lists of 32-bit little-endian numbers, each after its length, in files .docs, .freqs and .sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import read_lines


def sequences(data: bytes) -> Iterator[np.ndarray]:
    """The lists of a file; empty ones are skipped, a last one that is cut off has what is there."""
    x, at = np.frombuffer(data, "<u4", len(data) // 4), 0
    while at < len(x):
        n = int(x[at])
        got = x[at + 1 : at + 1 + n]
        at += 1 + n
        if n:
            yield got


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """seq (number in the file, from 0), values. A file is read by one task, as its lists can only be found from its start."""

    def run(frames):
        for f in frames:
            for content in f["content"]:
                for k, s in enumerate(sequences(content)):
                    yield pd.DataFrame({"seq": [k], "values": [s.astype(np.int64)]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "seq long, values array<long>")


def read_collection(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(postings: term_id, doc_id, freq, num_docs; sizes: doc_id, doc_len). The first list of .docs must be the number of documents alone."""
    docs, freqs = read_sequences(spark, f"{base}.docs"), read_sequences(spark, f"{base}.freqs")
    head = docs.where("seq = 0").select(F.when(F.size("values") == 1, F.element_at("values", 1)).otherwise(F.raise_error(F.lit("the first list must hold the number of documents alone"))).cast("long").alias("num_docs"))
    lists = docs.where("seq > 0").select((F.col("seq") - 1).alias("term_id"), F.col("values").alias("d")).join(freqs.select(F.col("seq").alias("term_id"), F.col("values").alias("f")), "term_id")
    p = lists.select("term_id", F.explode(F.arrays_zip("d", "f")).alias("x")).select("term_id", F.col("x.d").alias("doc_id"), F.col("x.f").alias("freq"))
    sizes = read_sequences(spark, f"{base}.sizes").where("seq = 0").select(F.posexplode("values").alias("doc_id", "doc_len")).withColumn("doc_id", F.col("doc_id").cast("long"))
    return p.crossJoin(head), sizes  # one row on the right


def write_collection(lists: DataFrame, sizes: DataFrame, num_docs: int, base: str) -> None:
    """Write the three files beside each other, one list at a time; term_ids must be 0, 1, ... and doc_ids of sizes too."""
    order = F.sort_array(F.collect_list(F.struct("doc_id", "freq"))).alias("x")
    rows = lists.groupBy("term_id").agg(order).orderBy("term_id").toLocalIterator()
    word = lambda v: np.asarray(v, "<u4").tobytes()
    with open(f"{base}.docs", "wb") as d, open(f"{base}.freqs", "wb") as f:
        d.write(word([1, num_docs]))
        for r in rows:
            d.write(word([len(r["x"]), *(x["doc_id"] for x in r["x"])]))
            f.write(word([len(r["x"]), *(x["freq"] for x in r["x"])]))
    with open(f"{base}.sizes", "wb") as s:
        s.write(word([num_docs]))
        for r in sizes.orderBy("doc_id").select("doc_len").toLocalIterator():
            s.write(word([r["doc_len"]]))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """term_id (the line's number, from 0), term; of equal lines the last counts. A missing file is an error."""
    return read_lines(spark, path).groupBy(F.col("value").alias("term")).agg(F.max("n").alias("term_id"))


def write_mapped_queries(mapped: DataFrame, path: str, stems_path: str | None = None) -> None:
    """Query lines of ids with tabs, in the order of queries; those of stem ids, line by line beside them, if asked for."""
    both = F.sort_array(F.collect_list(F.struct("pos", *[c for c in ("term_id", "stem_id") if c in mapped.columns])))  # words of one query
    lines = mapped.groupBy("query_id").agg(both.alias("x")).orderBy("query_id")
    for column, to in (("term_id", path), ("stem_id", stems_path)):
        if to:
            lines.select(F.concat_ws("\t", F.col("x")[column].cast("array<string>")).alias("value")).write.mode("overwrite").text(to)
