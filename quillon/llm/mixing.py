"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Rows that a range of keys aims at, and cells for each doubling of a key that ranges are cut from.
RANGE_ROWS, CELLS = 1 << 12, 4096


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets by water filling. sizes: (source_key, source, source_size), a row for each source.

    Sources in code point order, null last, weigh `weights` repeating. They share `share` times all sizes; none gets more
    than `cap` times its own size, and the excess goes to the others by weight until none is above. A source of size 0 has
    target 0; no sources give no rows. The windows see one row for each source, never the documents."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "name_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("name_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    d = sizes.withColumn("name_rank", F.row_number().over(by_name)).withColumn("weight", weight.cast("double"))
    d = d.withColumn("limit", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("limit") / F.col("weight"))
    d = d.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("level", (F.col("total") - before) / rest)
    d = d.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return d.select("source_key", "source_size", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def exponential_key(doc_id: Column, quality: Column, seed: int = 42) -> Column:
    """-ln(u)/quality with u in (0, 1] from 52 bits of the md5 of seed and id: the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52))
    return -F.log(u) / quality


def row_hash(text: Column) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(text.cast("string"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, text_hash, source, size, source_size, target, taken, copies.

    size: words of the text. Each source gets whole epochs first; the rest of its target is filled in the order of
    exponential keys divided by a quality weight (quality: doc_id, weight > 0; 0.5 where a document has none), the last
    document in part. taken: words that the mix takes, repeats counted, at most `cap` times the size. copies: times that the
    document appears, a part counting as one. text_hash: row_hash() of the text, as rows can share an id.
    Defined results: null or empty text has size 0 and is never taken; null sources are one source; rows with the same id
    have the same key and are taken in order of size; an empty table gives no rows; other columns are ignored.
    Cells of like keys are counted for each source, CELLS for each doubling; ranges of RANGE_ROWS rows and a cell's are cut from
    the counts and prefix-summed, so the sort of a source is dealt evenly, whatever its weights and however many rows it has."""
    d = docs.select("doc_id", "source", row_hash(F.col("text")).alias("text_hash"), word_count(F.col("text")).alias("size"))
    if quality is None:
        d = d.withColumn("quality", F.lit(0.5))
    else:
        q = quality.select(F.col("doc_id").alias("quality_id"), F.col("weight").cast("double").alias("quality")).where("quality_id is not null and quality > 0").groupBy("quality_id").agg(F.max("quality").alias("quality"))
        d = d.join(q, d.doc_id == q.quality_id, "left").withColumn("quality", F.coalesce("quality", F.lit(0.5)))
    d = d.withColumn("source_key", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")))
    d = d.withColumn("key", exponential_key(F.col("doc_id"), F.col("quality"), seed))
    # log2 spreads keys of all weights: a cell holds keys that differ little
    cell = F.when(F.col("key") > 0, F.greatest(F.lit(-64.0), F.log2("key")) + 64).otherwise(0.0)
    d = d.withColumn("cell", F.floor(cell * CELLS).cast("int"))
    d = materialize(d.select("doc_id", "text_hash", "source", "source_key", "size", "key", "cell"), "mix")

    sizes = d.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    # cells of a source: at most some hundred thousand, whatever the number of documents
    cells = d.groupBy("source_key", "cell").agg(F.sum("size").alias("cell_size"), F.count("*").alias("rows"))
    upto = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(upto), F.lit(0)))
    cells = cells.withColumn("range", F.floor(F.coalesce(F.sum("rows").over(upto), F.lit(0)) / RANGE_ROWS))
    cells = cells.withColumn("before", F.min("before").over(Window.partitionBy("source_key", "range")))
    cells = cells.join(targets, "source_key").select("source_key", "cell", "range", "before", "source_size", "target")
    cells = materialize(cells, "mix-ranges")

    inside = Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(cells, ["source_key", "cell"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    start = F.col("before") + F.sum("size").over(inside) - F.col("size")
    d = d.withColumn("epochs", epochs).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left - start)))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")
    copies = F.when(F.col("size") > 0, F.col("epochs") + (F.col("part") > 0).cast("long")).otherwise(0).alias("copies")
    return d.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken, copies)


def quality_of(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 1 for good, 0.25 for bad; unlabelled documents get mix()'s 0.5."""
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, 1.0).otherwise(0.25).alias("weight"))


#: DuckDB SQL for mix() with quality_of(labels), without copies.
MIX_SQL = r"""
WITH q AS (
  SELECT doc_id AS quality_id, max(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS quality
  FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1
), d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / coalesce(quality, 0.5::DOUBLE) AS key
  FROM {documents} docs LEFT JOIN q ON doc_id = quality_id
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS name_rank FROM d GROUP BY source
), w AS (
  SELECT *, ([5, 2, 1])[((name_rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS lim, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s
), l AS (
  SELECT *, lim / weight AS ratio, (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, name_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, name_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(lim, coalesce(weight * max(CASE WHEN level <= ratio THEN level END) OVER (), lim)) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken FROM r
"""
