"""Sharding by histogram sort: splitters from exact byte counts below probes, then one exchange."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

LOW, HIGH = 0, 1 << 128
PROBES = 32


def _keys(h: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Keys that sort as (signed h, signed i), as 16-byte strings."""
    out = np.empty((len(h), 2), ">u8")
    flip = np.uint64(1 << 63)
    out[:, 0] = h.astype(np.int64).view(np.uint64) ^ flip
    out[:, 1] = i.astype(np.int64).view(np.uint64) ^ flip
    return out.reshape(-1).view("S16")


def _pack(keys: list[int]) -> np.ndarray:
    return np.array([min(k, HIGH - 1).to_bytes(16, "big") for k in keys], "S16")


def _count(slim: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int]]:
    """For each of the len(probes) + 1 ranges: bytes, rows, smallest and largest key in it, exact over all rows."""
    packed = _pack(probes)

    def count(batches):
        n = len(packed) + 1
        total, rows, least, most = np.zeros(n, np.int64), np.zeros(n, np.int64), [b"\xff" * 16] * n, [b""] * n
        for b in batches:
            h, i, size = (b.column(k).to_numpy() for k in range(3))
            order = np.lexsort((i, h))
            k, size = _keys(h[order], i[order]), size[order]
            at = np.searchsorted(packed, k, side="right")
            total += np.bincount(at, size, n).astype(np.int64)
            rows += np.bincount(at, minlength=n)
            slots, first = np.unique(at, return_index=True)
            last = np.append(first[1:], len(at)) - 1
            for s, a, z in zip(slots.tolist(), k[first].tolist(), k[last].tolist(), strict=True):
                least[s], most[s] = min(least[s], a.ljust(16, b"\0")), max(most[s], z.ljust(16, b"\0"))
        keep = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array(total[keep]), pa.array(rows[keep]), pa.array([least[k] for k in keep], pa.binary()), pa.array([most[k] for k in keep], pa.binary())], names=["slot", "bytes", "n", "lo", "hi"])

    found = slim.mapInArrow(count, "slot int, bytes long, n long, lo binary, hi binary").groupBy("slot").agg(F.sum("bytes"), F.sum("n"), F.min("lo"), F.max("hi"))
    out = [(0, 0, HIGH, LOW)] * (len(probes) + 1)
    for s, size, n, lo, hi in found.collect():  # one row for each range of probes
        out[s] = (size, n, int.from_bytes(lo, "big"), int.from_bytes(hi, "big"))
    return out


def splitters(slim: DataFrame, parts: int, tolerance: float) -> tuple[list[int], int]:
    """parts - 1 keys between which about equal bytes lie, and the total of bytes.

    A splitter is final when the bytes below it are within tolerance * total / parts of its goal, or when no key lies between
    the two nearest probes; then the nearer one is taken. Probes between different first halves of the key leave equal first
    halves together; only a first half too heavy for the tolerance is cut by the second."""
    (total, n, lo, hi), *_ = _count(slim, [])
    if not n:
        return [], 0
    goals = [total * j / parts for j in range(1, parts)]
    span = {j: (lo, 0, hi + 1, total) for j in range(parts - 1)}
    chosen: dict[int, int] = {}
    for _ in range(64):
        probes = set()
        for a, _, z, _ in span.values():
            step = 1 << 64
            if (z - 1) >> 64 != a >> 64:
                top, end = (a >> 64) + 1, (z - 1) >> 64
                probes.update(((top + (end - top) * k // PROBES) * step) for k in range(PROBES + 1))
            else:
                probes.update(a + (z - a) * k // (PROBES + 1) for k in range(PROBES + 2))
        probes = sorted(p for p in probes if p < HIGH)
        counted = _count(slim, probes)
        below, edges = 0, [(lo, 0)]
        for k, p in enumerate(probes):
            below += counted[k][0]
            edges.append((p, below))
        edges.append((hi + 1, total))
        keys, sums = [e[0] for e in edges], np.array([e[1] for e in edges])
        filled = {k: counted[k] for k in range(len(counted)) if counted[k][1]}
        for j, (a, sa, z, sz) in list(span.items()):
            near = min((abs(int(sums[k]) - goals[j]), k) for k in (int(np.searchsorted(sums, goals[j])), max(0, int(np.searchsorted(sums, goals[j])) - 1)) if k < len(edges))
            if near[0] <= tolerance * total / parts:
                chosen[j] = keys[near[1]]
                del span[j]
                continue
            k = int(np.searchsorted(sums, goals[j]))  # the first edge at or above the goal; the range below it holds the goal
            _, _, first, last = filled[k - 1]
            if first == last:  # one key holds the goal
                chosen[j] = first if goals[j] - int(sums[k - 1]) <= int(sums[k]) - goals[j] else first + 1
                del span[j]
            else:
                span[j] = (first, int(sums[k - 1]), last + 1, int(sums[k]))
        if not span:
            break
    for j, (a, sa, z, sz) in span.items():
        chosen[j] = a if goals[j] - sa <= sz - goals[j] else z
    out = [chosen[j] for j in range(parts - 1)]
    return [max(out[: k + 1]) for k in range(len(out))], total


#: Rows that are sorted together inside a shard aim at this number.
RUN_ROWS = 1 << 18


def _runs(slim: DataFrame, total: int) -> DataFrame:
    """slim (shard, h, i) -> the same with `run`, a struct that goes up with (h, i) inside a shard; a run aims at RUN_ROWS rows.

    a: the top bits of h, as many as the number of rows asks for. In a run that is still large, as one with a large group of
    equal texts is, b counts the large groups before (and one more inside one), and c cuts such a group by ranges of i."""
    bits = max(0, min(62, (total // RUN_ROWS).bit_length()))
    d = slim.withColumn("a", (F.shiftright("h", 64 - bits) if bits else F.lit(0)).cast("long"))
    large = d.groupBy("shard", "a").count().where(F.col("count") > 4 * RUN_ROWS).select("shard", "a")
    large = materialize(large, "shard-large")  # a row for 4 RUN_ROWS rows at least
    zero = F.lit(0).cast("long")
    if large.isEmpty():
        discard(large)
        return d.withColumn("run", F.struct("a", zero.alias("b"), zero.alias("c"))).drop("a")
    group = d.join(large, ["shard", "a"], "left_semi").groupBy("shard", "a", "h").agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi")).where(F.col("n") > RUN_ROWS)
    # a null doc_id is the smallest number there is; widths are taken as doubles, whose rounding keeps the order
    lo = F.col("lo").cast("double")
    wide = (F.col("hi").cast("double") - lo + 1) / F.ceil(F.col("n") / RUN_ROWS)
    group = group.groupBy("shard", "a").agg(F.collect_list(F.struct(F.col("h").alias("of"), lo.alias("lo"), wide.alias("wide"))).alias("groups"))  # a struct for RUN_ROWS rows
    d = d.join(materialize(group, "shard-groups"), ["shard", "a"], "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<struct<of:long,lo:double,wide:double>>")))
    mine = F.filter("groups", lambda g: g["of"] == F.col("h"))
    b = 2 * F.size(F.filter("groups", lambda g: g["of"] < F.col("h"))) + F.size(mine)
    c = F.when(F.size(mine) > 0, F.floor((F.col("i").cast("double") - F.get(mine, 0)["lo"]) / F.get(mine, 0)["wide"])).otherwise(0)
    return d.withColumn("run", F.struct("a", b.cast("long").alias("b"), c.cast("long").alias("c"))).drop("a", "groups")


def shard(df: DataFrame, shards: int = 24, tolerance: float = 0.002) -> DataFrame:
    """All columns of df, plus shard (0 to shards - 1) and slot (0, 1, ... in each shard): sizes near equal (law `bytes`).

    Rows are sorted by (xxhash64 of text, doc_id), so equal texts stay together unless a group is too large for the
    tolerance; then it is cut by doc_id into neighbouring shards. Size: UTF-8 bytes plus 8. Bytes below each boundary between
    shards differ from the goal by tolerance of a shard, or by half the row that lies on the goal. The shards' boundaries are
    all that goes to the driver and back. Inside a shard, runs of rows are counted, and a slot is the rows of the runs before
    plus the place in the run, so a shard of any size is sorted by many tasks.
    Defined results: null text counts as empty, null doc_id sorts as the smallest; rows with the same text and doc_id come in
    any order; an empty table gives no rows; df may have any other columns but shard and slot, which it replaces."""
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    i = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    slim = materialize(df.select(h.alias("h"), i.alias("i"), size.alias("size")), "shard-keys")
    cuts, _ = splitters(slim, shards, tolerance)
    packed, total = _pack(cuts), slim.count()

    @F.pandas_udf("int")
    def part(h, i):
        import pandas as pd

        return pd.Series(np.searchsorted(packed, _keys(h.to_numpy(), i.to_numpy()), side="right").astype(np.int32))

    runs = _runs(slim.withColumn("shard", part("h", "i")), total).groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("shard", "run", before.alias("before")), "shard-runs")  # a row for each run
    d = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], h.alias("h"), i.alias("i"))
    d = _runs(d.withColumn("shard", part("h", "i")), total).join(runs, ["shard", "run"])
    row = F.row_number().over(Window.partitionBy("shard", "run").orderBy("h", "i")).cast("long") - 1
    return d.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "shard", (F.col("before") + row).alias("slot"))
