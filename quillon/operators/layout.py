"""Cursor access, blocks, sizes and entropy-coding contexts of posting lists (term_id, doc_id, freq, num_docs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import bits
from .index import positioned


def _by_doc() -> WindowSpec:
    return Window.partitionBy("term_id").orderBy("doc_id")


def next_posting(lists: DataFrame) -> DataFrame:
    after = F.coalesce(F.lead("doc_id").over(_by_doc()), F.col("num_docs"))
    return lists.select("term_id", "doc_id", after.alias("next_doc_id"))


def next_geq(lists: DataFrame, parts: int = 8) -> DataFrame:
    """For each list and each probe num_docs * i / parts: the first doc_id at or above it, else num_docs, and its position."""
    probe = [F.floor(F.col("num_docs") * i / parts) for i in range(parts + 1)]
    d = lists.groupBy("term_id", "num_docs").agg(*[F.min(F.when(F.col("doc_id") >= p, F.col("doc_id"))).alias(f"d{i}") for i, p in enumerate(probe)], *[F.count_if(F.col("doc_id") < p).alias(f"p{i}") for i, p in enumerate(probe)])
    rows = F.array(*[F.struct(p.alias("probe"), F.coalesce(f"d{i}", "num_docs").alias("doc_id"), F.col(f"p{i}").alias("position")) for i, p in enumerate(probe)])
    return d.select("term_id", F.explode(rows).alias("x")).select("term_id", "x.*")


def move_to(lists: DataFrame) -> DataFrame:
    """First, middle and last posting of each list, by position."""
    d = positioned(lists).where("position in (0, size div 2, size - 1)")
    return d.select("term_id", "position", "doc_id", "freq", "size")


def prev_value(lists: DataFrame) -> DataFrame:
    return lists.select("term_id", "doc_id", F.lag("doc_id", 1, 0).over(_by_doc()).alias("prev_value"))


def freq_prefix_sums(lists: DataFrame) -> DataFrame:
    total = F.sum("freq").over(_by_doc().rowsBetween(Window.unboundedPreceding, 0))
    return positioned(lists).select("term_id", "position", total.alias("value"))


def positive_decode(lists: DataFrame) -> DataFrame:
    """Frequencies back from their prefix sums."""
    order = Window.partitionBy("term_id").orderBy("position")
    return freq_prefix_sums(lists).select("term_id", "position", (F.col("value") - F.lag("value", 1, 0).over(order)).alias("value"))


def blocks(lists: DataFrame, size: int = 128) -> DataFrame:
    """One row a block: term_id, block_no, list_size, n, block_base, block_max, gaps and freqs (less 1) in order."""
    d = positioned(lists).withColumn("block_no", F.floor(F.col("position") / size))
    pair = F.sort_array(F.collect_list(F.struct("position", "gap", (F.col("freq") - 1).alias("f"))))  # at most `size` of them
    d = d.groupBy("term_id", "block_no").agg(F.max("size").alias("list_size"), F.count("*").alias("n"), F.min("before").alias("before"), F.max("doc_id").alias("block_max"), pair.alias("x"))
    return d.select("term_id", "block_no", "list_size", "n", (F.col("before") + 1).alias("block_base"), "block_max", F.col("x.gap").alias("gaps"), F.col("x.f").alias("freqs"))


def block_layout(lists: DataFrame, size: int = 128) -> DataFrame:
    overhead = F.when(F.col("block_no") == 0, 4).otherwise(8).cast("long")
    return blocks(lists, size).select("term_id", "block_no", "n", "block_base", "block_max", overhead.alias("overhead_bytes"))


def block_bytes(lists: DataFrame, size: int = 128) -> DataFrame:
    """Bytes of each block's gaps and frequencies at four and at seven-bit bytes."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + bits.vbyte_bytes(v))
    return blocks(lists, size).select("term_id", "block_no", "list_size", "n", total("gaps").alias("vbyte_doc_bytes"), total("freqs").alias("vbyte_freq_bytes"), (4 * F.col("n")).alias("u32_bytes"))


def block_size_stats(lists: DataFrame, size: int = 128) -> DataFrame:
    """Sums over full blocks, the last blocks of longer lists, and short lists."""
    kind = F.when(F.col("list_size") < size, "small").when(F.col("n") == size, "full").otherwise("last")
    overhead = F.when(F.col("block_no") == 0, 4).otherwise(8)
    sums = [F.sum(c).cast("long").alias(c) for c in ("vbyte_doc_bytes", "vbyte_freq_bytes", "u32_bytes")]
    d = block_bytes(lists, size).withColumn("class", kind).withColumn("o", overhead)
    return d.groupBy("class").agg(F.count("*").alias("blocks"), F.sum("n").alias("postings"), F.sum("o").cast("long").alias("overhead_bytes"), *sums)


def index_size_stats(lists: DataFrame, size: int = 128) -> DataFrame:
    """One row: bytes of documents, frequencies and block tables, and bits for each posting."""
    d = block_bytes(lists, size).withColumn("o", F.when(F.col("block_no") == 0, 4 + bits.vbyte_bytes(F.col("list_size"))).otherwise(8))
    d = d.agg(F.sum("vbyte_doc_bytes").alias("docs_size"), F.sum("vbyte_freq_bytes").alias("freqs_size"), F.sum("o").cast("long").alias("meta_size"), F.sum("n").alias("postings"))
    return d.withColumns({"bits_per_doc": F.round(8 * F.col("docs_size") / F.col("postings"), 9), "bits_per_freq": F.round(8 * F.col("freqs_size") / F.col("postings"), 9)})


def list_sizes(lists: DataFrame) -> DataFrame:
    """term_id, n, occurrences, universe, last."""
    return lists.groupBy("term_id").agg(F.count("*").alias("n"), F.sum("freq").alias("occurrences"), F.max("num_docs").alias("universe"), F.max("doc_id").alias("last"), F.min("doc_id").alias("first"))


def sequence_sizes(lists: DataFrame) -> DataFrame:
    """Bits of each list under every whole-list layout."""
    u, n, o = F.col("universe"), F.col("n"), F.col("occurrences")
    kind, size = bits.indexed(u, n)
    strict_kind, strict_size = bits.strict(o + 1, n)
    return list_sizes(lists).select(
        "term_id", "n", "universe", bits.elias_fano_bits(u, n).alias("ef_bits"), bits.strict_elias_fano_bits(u, n).alias("strict_ef_bits"), bits.bitmap_bits(u, n).alias("bitmap_bits"), bits.all_ones_bits(u, n).alias("all_ones_bits"),
        kind.alias("indexed_type"), size.alias("indexed_bits"), strict_kind.alias("freq_type"), strict_size.alias("freq_bits"), bits.list_header_bits(o).alias("header_bits"),
    )


def uniform_partitions(lists: DataFrame, size: int = 128) -> DataFrame:
    """One row a partition of `size` postings: base, universe, n, layout and bits."""
    d = positioned(lists).withColumn("part", F.floor(F.col("position") / size))
    d = d.groupBy("term_id", "part").agg(F.count("*").alias("n"), F.min("before").alias("before"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("num_docs").alias("universe"), F.max("size").alias("size"))
    d = d.withColumn("base", F.when(F.col("part") == 0, F.col("first")).otherwise(F.col("before") + 1))
    kind, cost = bits.indexed(F.col("last") - F.col("base") + 1, F.col("n"))
    return d.select("term_id", "part", "n", "size", "universe", "base", "last", kind.alias("type"), cost.alias("bits"))


def uniform_partition_sizes(lists: DataFrame, size: int = 128) -> DataFrame:
    """term_id, partitions, bits: of the whole uniformly partitioned layout."""
    p = uniform_partitions(lists, size)
    d = p.groupBy("term_id").agg(F.count("*").alias("partitions"), F.sum("bits").alias("body"), F.max("size").alias("n"), F.max("universe").alias("universe"), F.max("last").alias("last"), F.min("base").alias("base"))
    k, u, n, body = F.col("partitions"), F.col("universe"), F.col("n"), F.col("body")
    tail = F.when(F.col("last") + 1 == u, bits.delta_bits(F.lit(0).cast("long"))).otherwise(bits.delta_bits(F.col("last") - F.col("base")))
    one = bits.gamma_bits(k - 1) + bits.ceil_log2(u) + F.when(n > 1, tail).otherwise(0) + body
    ends = bits.ceil_log2(body + 1)
    many = bits.gamma_bits(k - 1) + bits.gamma_bits(ends) + bits.elias_fano_bits(u, k + 1) + (k - 1) * ends + body
    return d.select("term_id", "partitions", F.when(k == 1, one).otherwise(many).alias("bits"))


def endpoints(lists: DataFrame) -> DataFrame:
    """Where each list ends when encoded one after the other, by term_id; runs of 4096 ids are summed first."""
    d = sequence_sizes(lists).select("term_id", (F.col("indexed_bits") + F.col("freq_bits") + F.col("header_bits")).alias("bits")).withColumn("run", F.floor(F.col("term_id") / 4096))
    runs = d.groupBy("run").agg(F.sum("bits").alias("b"))
    before = F.coalesce(F.sum("b").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("bits").over(Window.partitionBy("run").orderBy("term_id").rowsBetween(Window.unboundedPreceding, 0))
    return d.join(runs.select("run", before.alias("before")), "run").select("term_id", (F.col("before") + inside).alias("endpoint"))


def streams(lists: DataFrame, size: int = 256) -> DataFrame:
    """stream ('doc' or 'freq'), term_id, block_no, n, list_size, known (sum of the gaps, from the block table; null for freqs), values."""
    b = blocks(lists, size)
    known = F.col("block_max") - F.col("block_base") - F.col("n") + 1
    rows = F.array(F.struct(F.lit("doc").alias("stream"), known.alias("known"), F.col("gaps").alias("values")), F.struct(F.lit("freq").alias("stream"), F.lit(None).cast("long").alias("known"), F.col("freqs").alias("values")))
    return b.select("term_id", "block_no", "n", "list_size", F.explode(rows).alias("x")).select("x.stream", "term_id", "block_no", "n", "list_size", "x.known", "x.values")


def with_contexts(lists: DataFrame) -> DataFrame:
    """streams() and the model that each context rule picks for a block."""
    s = F.array_sort("values")
    at = lambda i: bits.selector(F.element_at("s", i.cast("int")) + 1)
    d = streams(lists).withColumn("s", s)
    top, low, mid, p90 = at(F.col("n")), at(F.lit(1)), at(F.floor(F.col("n") / 2) + 1), at(F.floor(9 * F.col("n") / 10) + 1)
    some = F.element_at("s", F.col("n").cast("int")) != 0
    marked = lambda c: F.when((c == 0) & some, 1).otherwise(c).cast("long")
    return d.select("stream", "term_id", "block_no", "n", "list_size", "known", "values", top.alias("max"), (16 * top + low).alias("minmax"), marked(16 * p90 + mid).alias("med90p"), marked(16 * top + mid).alias("medmax"))


def contexts(lists: DataFrame) -> DataFrame:
    return with_contexts(lists).drop("values", "known", "list_size")


def symbol_counts(lists: DataFrame, context: str = "medmax") -> DataFrame:
    """stream, model_id, symbol, count; document blocks of up to ten postings are coded otherwise and not counted."""
    d = with_contexts(lists).where("stream = 'freq' or n > 10").select("stream", F.col(context).alias("model_id"), F.explode("values").alias("v"))
    return d.groupBy("stream", "model_id", bits.msb_symbol(F.col("v") + 1).alias("symbol")).agg(F.count("*").alias("count"))


def magnitude_counts(lists: DataFrame, context: str = "max") -> DataFrame:
    """stream, model_id, mag, count, max_value: for models over magnitudes."""
    d = with_contexts(lists).select("stream", F.col(context).alias("model_id"), F.explode("values").alias("v"))
    return d.groupBy("stream", "model_id", bits.magnitude(F.col("v") + 1).alias("mag")).agg(F.count("*").alias("count"), (F.max("v") + 1).alias("max_value"))


def entropy(lists: DataFrame, context: str = "medmax") -> DataFrame:
    """stream, model_id, total, entropy: bits that the model's symbols need at least."""
    c = symbol_counts(lists, context).withColumn("total", F.sum("count").over(Window.partitionBy("stream", "model_id")))
    return c.groupBy("stream", "model_id", "total").agg(F.round(F.sum(F.col("count") * F.log2(F.col("total") / F.col("count"))), 4).alias("entropy"))


def quantiles(values: DataFrame, at: tuple[int, ...] = (50, 90, 95)) -> DataFrame:
    """values (value) -> one row: avg, and for each p the value at place p * n / 100 of the sorted ones, not interpolated.

    Values are counted by whole part first; only the parts that hold a wanted place are sorted."""
    v = values.where("value is not null").select(F.col("value").cast("double"), F.floor("value").alias("part"))
    parts = v.groupBy("part").agg(F.count("*").alias("k"))
    ends = F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    total = v.agg(F.count("*").alias("n"), F.avg("value").alias("avg"))
    parts = parts.select("part", "k", ends.alias("end")).crossJoin(total)  # one row on the right
    want = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.floor(F.col("n") * p / 100).alias("place")) for p in at]))
    parts = parts.select("part", (F.col("end") - F.col("k")).alias("start"), "end", "avg", want.alias("x")).where("x.place >= start and x.place < end").select("part", "start", "avg", "x.p", "x.place")
    row = F.row_number().over(Window.partitionBy("p").orderBy("value")) - 1 + F.col("start")
    d = v.join(parts, "part").withColumn("row", row).where("row = place")
    return d.groupBy(F.round("avg", 6).alias("avg")).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"q{p}") for p in at])
