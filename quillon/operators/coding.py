"""Encoding and checking of posting lists with the codecs, by blocks and by lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ans, sequences
from ..functions.codecs import BLOCK_CODECS
from ..functions.partition import optimal_partition
from .layout import magnitude_counts, streams, symbol_counts, with_contexts

_STATS = "stream string, blocks long, postings long, bytes long, mismatches long"


def _summed(d: DataFrame, **names) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("blocks", "postings", "bytes", "mismatches")]
    return d.groupBy("stream").agg(*sums).select(*[F.lit(v).alias(k) for k, v in names.items()], "stream", *["blocks", "postings", "bytes", "mismatches"])


def encode_blocks(lists: DataFrame, codec: str, size: int = 128) -> DataFrame:
    """stream, term_id, block_no, n, list_size, payload, wrong (does it decode to anything else?). The sum of a block's gaps is in
    the block table, that of its frequencies is not."""
    encode, decode = BLOCK_CODECS[codec]

    def run(frames):
        for f in frames:
            known = [None if k != k else int(k) for k in f["known"].tolist()]
            values = [v.tolist() for v in f["values"]]
            f["payload"] = [encode(v, k) for v, k in zip(values, known, strict=True)]
            f["wrong"] = [int(decode(p, len(v), k) != v) for p, v, k in zip(f["payload"], values, known, strict=True)]
            yield f[["stream", "term_id", "block_no", "n", "list_size", "payload", "wrong"]]

    return streams(lists, size).mapInPandas(run, "stream string, term_id long, block_no long, n long, list_size long, payload binary, wrong long")


def verify_blocks(lists: DataFrame, codec: str, size: int = 128) -> DataFrame:
    """codec, stream, blocks, postings, bytes, mismatches (blocks that decode to anything else; 0 is right)."""
    d = encode_blocks(lists, codec, size).select("stream", F.lit(1).alias("blocks"), F.col("n").alias("postings"), F.octet_length("payload").cast("long").alias("bytes"), F.col("wrong").alias("mismatches"))
    return _summed(d, codec=codec)


#: Documents of a segment: a list's postings in one segment are coded by one task, in the segment's universe.
SEGMENT = 1 << 24


def encode_lists(lists: DataFrame, kind: str) -> DataFrame:
    """term_id, segment, n, docs_bits, freqs_bits, docs_payload, freqs_payload, wrong: lists as sequences of an index type, whole in
    each segment of SEGMENT documents. wrong: does any way of reading them back (all, by position, by document) fail?"""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("doc_id")
        docs, freqs, universe = f["doc_id"].to_numpy() - int(f["segment"].iloc[0]) * SEGMENT, f["freq"].to_numpy(), int(f["universe"].iloc[0])
        d, q = sequences.write_list(kind, docs, freqs, universe)
        data = sequences.pack(d), sequences.pack(q)
        a, b = sequences.read_list(kind, *map(sequences.unpack, data), universe)
        some = np.unique(np.linspace(0, len(docs) - 1, 9).astype(int)).tolist()
        good = np.array_equal(a.decode(), docs) and np.array_equal(b.decode(), freqs)
        good = good and all(a.move(i) == (i, docs[i]) and b.move(i) == (i, freqs[i]) and a.next_geq(int(docs[i])) == (i, docs[i]) for i in some)
        good = good and a.next_geq(int(docs[-1]) + 1) == (len(docs), universe) == a.move(len(docs))
        row = (int(f["term_id"].iloc[0]), int(f["segment"].iloc[0]), len(docs), len(d), len(q), *data, int(not good))
        return pd.DataFrame([row], columns=["term_id", "segment", "n", "docs_bits", "freqs_bits", "docs_payload", "freqs_payload", "wrong"])

    d = lists.withColumn("segment", F.floor(F.col("doc_id") / SEGMENT))
    d = d.withColumn("universe", F.least(F.lit(SEGMENT), F.col("num_docs") - F.col("segment") * SEGMENT))
    return d.groupBy("term_id", "segment").applyInPandas(run, "term_id long, segment long, n long, docs_bits long, freqs_bits long, docs_payload binary, freqs_payload binary, wrong long")


def list_bits(lists: DataFrame, kind: str) -> DataFrame:
    """term_id, n, docs_bits, freqs_bits, mismatches: measured on the encoded lists."""
    d = encode_lists(lists, kind).groupBy("term_id")
    return d.agg(F.sum("n").alias("n"), F.sum("docs_bits").alias("docs_bits"), F.sum("freqs_bits").alias("freqs_bits"), F.sum("wrong").alias("mismatches"))


def ans_models(lists: DataFrame, context: str = "medmax", merge: bool = True, packed: bool = False) -> tuple[dict, dict]:
    """First pass: models by stream and number, and the model of each (stream, context). Counts of at most 2 x 256 x 1,025 symbols,
    or 2 x 16 x 33 magnitudes, come to the driver."""
    counts: dict = {}
    most: dict = {}
    found = magnitude_counts(lists, context) if packed else symbol_counts(lists, context)
    for r in found.collect():
        counts.setdefault(r["stream"], {}).setdefault(r["model_id"], {})[r["mag" if packed else "symbol"]] = r["count"]
        if packed:
            most[r["stream"], r["model_id"]] = max(r["max_value"], most.get((r["stream"], r["model_id"]), 0))
    homes, models = {}, {}
    for stream, by in counts.items():
        to = ans.merged(by) if merge else {m: m for m in by}
        sums: dict = {}
        for m, c in by.items():
            homes[stream, m] = to[m]
            for s, n in c.items():
                sums.setdefault(to[m], {})
                sums[to[m]][s] = sums[to[m]].get(s, 0) + n
        models[stream] = {m: ans.MagnitudeModel(c, most[stream, m]) if packed else ans.ByteModel(c) for m, c in sums.items() if m}
    return models, homes


def model_tables(lists: DataFrame, context: str = "medmax", merge: bool = True, packed: bool = False) -> DataFrame:
    """stream, context, model_id, frame, kind (how its decoding table is laid out): the models of an index, as they are stored."""
    models, homes = ans_models(lists, context, merge, packed)
    kind = lambda m: ("magnitudes" if m.by_magnitude else "values") if m.packed else "fast" if m.fast else "compact"
    rows = [(s, int(c), int(to), models[s][to].size if to else 0, kind(models[s][to]) if to else "none") for (s, c), to in homes.items()]
    return lists.sparkSession.createDataFrame(rows, "stream string, context long, model_id long, frame long, kind string")


def ans_blocks(lists: DataFrame, context: str = "medmax", merge: bool = True, packed: bool = False) -> DataFrame:
    """Second pass: stream, term_id, block_no, n, list_size, model_id, payload, wrong (does it decode to anything else?)."""
    models, homes = ans_models(lists, context, merge, packed)
    held = lists.sparkSession.sparkContext.broadcast((models, homes))  # at most 2 x 63 (merged) or 2 x 256 models of 1,025 symbols
    wide = merge or context not in ("max",)

    def run(frames):
        models, homes = held.value
        for f in frames:
            parts = []
            for stream, g in f.groupby("stream", sort=False):
                blocks = [np.asarray(v, np.int64) for v in g["values"]]
                ids = [homes.get((stream, m), 0) for m in g["m"]]
                docs, known = stream == "doc", g["known"].tolist()
                data = ans.encode_blocks(blocks, ids, models.get(stream, {}), docs, wide)
                back = ans.decode_blocks(data, [len(b) for b in blocks], models.get(stream, {}), docs, wide, known)
                wrong = [int(not np.array_equal(a, b)) for a, b in zip(blocks, back, strict=True)]
                parts.append(g[["stream", "term_id", "block_no", "n", "list_size"]].assign(model_id=ids, payload=data, wrong=wrong))
            yield pd.concat(parts) if parts else f.iloc[:0].reindex(columns=["stream", "term_id", "block_no", "n", "list_size", "model_id", "payload", "wrong"])

    d = with_contexts(lists).select("stream", "term_id", "block_no", "n", "list_size", "known", F.col(context).alias("m"), "values")
    return d.mapInPandas(run, "stream string, term_id long, block_no long, n long, list_size long, model_id long, payload binary, wrong long")


def verify_ans(lists: DataFrame, context: str = "medmax", merge: bool = True, packed: bool = False) -> DataFrame:
    """context, stream, blocks, postings, bytes, mismatches."""
    d = ans_blocks(lists, context, merge, packed).groupBy("stream").agg(F.count("*").alias("blocks"), F.sum("n").alias("postings"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"), F.sum("wrong").alias("mismatches"))
    return d.select(F.lit("packed" if packed else context).alias("context"), "stream", "blocks", "postings", "bytes", "mismatches")


def ans_block_size_stats(lists: DataFrame, size: int = 256, **models) -> DataFrame:
    """class, blocks, postings, overhead_bytes, doc_bytes, freq_bytes: of the coded blocks, by full blocks, last ones and short lists."""
    kind = F.when(F.col("list_size") < size, "small").when(F.col("n") == size, "full").otherwise("last")
    d = ans_blocks(lists, **models).withColumn("class", kind).withColumn("bytes", F.octet_length("payload"))
    doc = F.col("stream") == "doc"
    of = lambda s, c: F.coalesce(F.sum(F.when(s, c)), F.lit(0)).cast("long")
    over = F.when(F.col("block_no") == 0, 4).otherwise(8)
    return d.groupBy("class").agg(F.count_if(doc).alias("blocks"), of(doc, F.col("n")).alias("postings"), of(doc, over).alias("overhead_bytes"), of(doc, F.col("bytes")).alias("doc_bytes"), of(~doc, F.col("bytes")).alias("freq_bytes"))


def merged_models(lists: DataFrame, context: str = "medmax") -> DataFrame:
    """stream, context, model_id, size: the model that each context has after merging, and its frame size."""
    return model_tables(lists, context).select("stream", "context", "model_id", F.col("frame").alias("size"))


def optimal_partitions(lists: DataFrame, freqs: bool = False) -> DataFrame:
    """term_id, part, n, base, last: near-optimal partitions of each list's documents, or of its frequencies' running sums.

    The choice goes along a list, so a list's postings in one segment of SEGMENT documents are one task's; parts are numbered
    through the segments."""
    base = sequences.STRICT if freqs else sequences.INDEXED

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("doc_id")
        v = (f["freq"].cumsum() if freqs else f["doc_id"] - int(f["segment"].iloc[0]) * SEGMENT).tolist()
        ends = optimal_partition(v, v[-1] + 1 if freqs else int(f["universe"].iloc[0]), cost=base.bits)
        starts = [0, *ends[:-1]]
        shift = 0 if freqs else int(f["segment"].iloc[0]) * SEGMENT
        rows = [(int(f["term_id"].iloc[0]), int(f["segment"].iloc[0]), k, z - a, shift + (v[0] if a == 0 else v[a - 1] + 1), shift + v[z - 1]) for k, (a, z) in enumerate(zip(starts, ends, strict=True))]
        return pd.DataFrame(rows, columns=["term_id", "segment", "k", "n", "base", "last"])

    d = lists.withColumn("segment", F.floor(F.col("doc_id") / SEGMENT))
    d = d.withColumn("universe", F.least(F.lit(SEGMENT), F.col("num_docs") - F.col("segment") * SEGMENT))
    d = d.groupBy("term_id", "segment").applyInPandas(run, "term_id long, segment long, k long, n long, base long, last long")
    part = F.row_number().over(Window.partitionBy("term_id").orderBy("segment", "k")).cast("long") - 1
    return d.select("term_id", part.alias("part"), "n", "base", "last")


def partition_lengths(lists: DataFrame, least: int = 4096) -> DataFrame:
    """stream, lists, mean_length: mean postings of a partition over lists of `least` postings or more, of documents and frequencies."""
    both = None
    for stream, freqs in (("doc", False), ("freq", True)):
        d = optimal_partitions(lists, freqs).groupBy("term_id").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).where(F.col("n") >= least)
        d = d.agg(F.count("*").alias("lists"), F.try_divide(F.sum("n").cast("double"), F.sum("parts")).alias("mean_length")).select(F.lit(stream).alias("stream"), "lists", "mean_length")
        both = d if both is None else both.union(d)
    return both


def decode_stats(lists: DataFrame, context: str = "medmax") -> DataFrame:
    """stream, model_id, blocks, values, bytes: what decoding the whole index does with each model of leading bytes."""
    d = ans_blocks(lists, context)
    return d.groupBy("stream", "model_id").agg(F.count("*").alias("blocks"), F.sum("n").alias("values"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))
