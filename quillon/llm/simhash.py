"""SimHash near-dedup: fingerprints of word shingles and bit-sliced comparison within candidate blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, discard, materialize, mix64
from .components import connected_components

RADIUS = 4
#: Two of these blocks at least are equal in fingerprints at most RADIUS bits apart: RADIUS + 2 blocks.
BLOCKS = RADIUS + 2
#: A bucket with more fingerprints is dealt again by the bits that its key leaves out.
HOT = 1 << 14
#: Parts that the rows of a large component are dealt into where its smallest row goes back to all of them.
SALTS = 32
#: Groups up to this size are compared by shifts of the whole batch, larger ones by pivots.
SMALL = 64
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of lower-cased (A-Z) text over shingles of `words` words, repeats counted; 0 without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[words - 1 :].tolist() or [len(joined)]
    digest, n = xxhash.xxh64_intdigest, len(ends)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # memory stays small in very long texts
        h = np.array([digest(joined[a:z], 42) for a, z in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=False)], np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """XXH64 of every shingle of lower-cased (A-Z) text, repeats kept; with fewer words one of the whole sequence, none without."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[words - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:z], 42) for a, z in zip(starts, ends, strict=False)), np.uint64, len(ends))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """uint64[n] or uint64[n, m] -> uint64[64 m, ceil(n/64)]: word w of plane p has bit p of fingerprints 64w to 64w+63."""
    n = len(fps)
    raw = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    bits = np.zeros((-(-n // 64) * 64, raw.shape[1]), np.uint8)
    bits[:n] = raw
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def _within(xored, dead: np.ndarray, radius: int, planes: int = 64) -> np.ndarray:
    """Lanes whose distance is at most radius, as bits like `dead`, which marks lanes that don't count.

    xored(p, live) gives plane p of the differences, for the words in `live` (all if None). Carry-save counters and a sticky
    overflow hold 64 distances in each word; words in which every lane is beyond the radius are abandoned."""
    out, live = np.zeros_like(dead), None
    counters, over = [np.zeros_like(dead) for _ in range(max(1, radius.bit_length()))], dead.copy()
    looks = set(range(max(20, 2 * radius + 8), planes, max(12, planes // 16)))
    for p in range(planes):
        if p in looks:
            keep = (over | _above(counters, radius)) != _ONES
            if not keep.any():
                return out
            if 4 * keep.sum() < 3 * keep.size:
                at = np.nonzero(keep)
                live = at if live is None else tuple(x[at[0]] for x in live)
                counters, over = [c[keep] for c in counters], over[keep]
        carry = xored(p, live)
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        over = over | carry
    got = ~(over | _above(counters, radius))
    if live is None:
        return got
    out[live] = got
    return out


def _above(counters, radius):
    """Bits of the lanes whose count is over radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ONES)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | (equal & counters[k])
            equal = equal & ~counters[k]
    return above


def _pack(mask: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(mask, axis=-1, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def shift_links(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of one group within radius; group must be sorted. Lane i is compared with lane i + s for each shift s."""
    left, right = [], []
    planes, s = bit_planes(fps), 1
    while s < len(group):
        same = group[s:] == group[:-s]
        if not same.any():
            break
        end = np.flatnonzero(same)[-1] + 1
        group, same, words = group[: end + s], same[:end], -(-end // 64)
        q, r = divmod(s, 64)
        need = words + q + 1
        planes = planes[:, :need] if planes.shape[1] >= need else np.pad(planes, ((0, 0), (0, need - planes.shape[1])))

        def xored(p, live, planes=planes, words=words, q=q, r=r):
            plane = planes[p]
            near, far = plane[q : q + words], plane[q + 1 : q + 1 + words]
            moved = near if not r else (near >> np.uint64(r)) | (far << np.uint64(64 - r))
            diff = plane[:words] ^ moved
            return diff if live is None else diff[live]

        got = _within(xored, ~_pack(same, words), radius, len(planes))
        i = _lanes(got)
        left.append(i)
        right.append(i + s)
        s += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def pivot_links(fps: np.ndarray, radius: int = RADIUS, allow=None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within radius: pairs (i, j). Reached lanes become pivots, 64 at a time, and leave the lanes.

    allow(i, js), if given, says which of the lanes js within radius of i link with it."""
    left, right = [], []
    at = np.arange(len(fps))
    planes, gone = bit_planes(fps), np.zeros(len(fps), bool)
    queue: list[np.ndarray] = []
    seed = 0
    while not gone.all():  # once every lane is reached, the pivots in the queue can link nothing more
        if 2 * gone.sum() > len(at) > 128:
            at, seed = at[~gone], 0
            planes, gone = bit_planes(fps[at]), np.zeros(len(at), bool)
        if not queue:
            while gone[seed]:
                seed += 1
            gone[seed] = True
            queue.append(at[seed : seed + 1])
            continue
        p = queue.pop()
        p, more = p[:64], p[64:]
        if len(more):
            queue.append(more)
        words = planes.shape[1]
        valid = np.zeros(words * 64, bool)
        valid[: len(at)] = ~gone
        dead = np.repeat(~_pack(valid, words)[None], len(p), axis=0)
        sign = np.unpackbits(np.ascontiguousarray(fps[p]).view(np.uint8).reshape(len(p), -1), axis=1, bitorder="little").astype(np.uint64) * _ONES  # a word for each pivot and plane
        got = _within(lambda b, live: planes[b][None] ^ sign[:, b][:, None] if live is None else planes[b][live[1]] ^ sign[live[0], b], dead, radius, len(planes))
        for k in range(len(p)):
            hit = _lanes(got[k])
            hit = hit[~gone[hit]]
            if allow is not None and len(hit):
                hit = hit[allow(int(p[k]), at[hit])]
            if len(hit):
                gone[hit] = True
                left.append(np.full(len(hit), p[k]))
                right.append(at[hit])
                queue.append(at[hit])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _masks(bits: list[int], n: int) -> list[int]:
    """n nearly equal runs of the given bits, as masks."""
    return [sum(1 << b for b in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def _signed(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _tables(mask_of_all: int) -> list[int]:
    blocks = _masks([b for b in range(64) if mask_of_all >> b & 1], BLOCKS)
    return [a | b for a, b in combinations(blocks, 2)]


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """distinct (fp, node), each fp once -> edges (a, b) between nodes that connect all fp within RADIUS bits, and no others.

    15 tables, one for each two of six blocks of bits: near fingerprints share a key in one at least. Buckets over HOT are
    dealt again by two of six blocks of their other bits, in which near ones again agree; of buckets that are large even then,
    each two blocks of rows are a task. Small buckets give a link in the first table that has it; larger ones give a spanning
    forest. Rows of a bucket are compared bit-sliced."""
    spark = distinct.sparkSession
    masks = _tables((1 << 64) - 1)
    first = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for t, m in enumerate(masks)]))
    rows = distinct.select("fp", "node", first.alias("x")).select("x.t", "x.key", "fp", "node")
    plain = np.array(masks, np.uint64)
    hot = materialize(rows.groupBy("t", "key").count().where(F.col("count") > HOT).select("t", "key"), "hot")  # one row for HOT at least
    if hot.isEmpty():
        discard(hot)
        rows = rows.withColumn("deep", F.lit(False))
    else:
        below = [(t, m | sub) for t, m in enumerate(masks) for sub in _tables(((1 << 64) - 1) ^ m)]
        of = spark.createDataFrame([(t, k, m - (1 << 64) if m >> 63 else m) for k, (t, m) in enumerate(below)], "t int, below int, mask long")
        again = rows.join(hot, ["t", "key"], "left_semi").join(F.broadcast(of), "t")  # 225 rows
        again = again.select(F.xxhash64("below", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "node")
        again = in_blocks(again).select(F.lit(len(masks)).alias("t"), F.col("task").alias("key"), "fp", "node", F.lit(True).alias("deep"))
        rows = rows.join(hot, ["t", "key"], "left_anti").withColumn("deep", F.lit(False)).unionByName(again)
    rows = rows.select("t", "key", "fp", "node", "deep").repartition("t", "key").sortWithinPartitions("t", "key")

    def first_table(t, fa, fb):
        """Is t the first table in which the pair shares a key?"""
        diff = fa ^ fb
        ok = np.ones(len(t), bool)
        for k in range(len(plain)):
            ok &= ~((k < t) & ((diff & plain[k]) == 0))
        return ok

    def compare(t, key, fp, node, deep):
        starts = np.concatenate([[0], np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1])
        sizes = np.diff(np.append(starts, len(t)))
        group = np.repeat(np.arange(len(starts)), sizes)
        mine = np.flatnonzero((sizes > 1)[group] & (sizes <= SMALL)[group])
        out = []
        if len(mine):
            mine = mine[np.lexsort((mine, -sizes[group[mine]]))]  # larger groups first: later shifts look at fewer lanes
            i, j = shift_links(fp[mine], group[mine])
            i, j = mine[i], mine[j]
            keep = deep[i] | first_table(t[i], fp[i], fp[j])
            out.append((node[i[keep]], node[j[keep]]))
        for g in np.flatnonzero(sizes > SMALL):
            s = slice(starts[g], starts[g] + sizes[g])
            i, j = pivot_links(fp[s])
            out.append((node[s][i], node[s][j]))
        return out

    def run(batches):
        held = None
        for b in batches:
            got = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            got[2] = got[2].view(np.uint64)
            held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            if len(held[0]) < 1 << 16:
                continue
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on
            if cut:
                for a, z in compare(*[x[:cut] for x in held]):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            for a, z in compare(*held):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id.

    component_id: the smallest doc_id that links reach, the document included; fingerprints link at RADIUS or fewer differing
    bits. Equal fingerprints are one node, however many documents have them.
    Defined results: null, empty and blank texts have fingerprint zero and link like any other; a null doc_id keeps its row
    and never names a component unless no document there has an id (then null); rows with the same doc_id and different texts
    are different nodes that share the id; an empty table gives no rows; other columns are ignored."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    d = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("node", F.col("fp")), "distinct")
    comps = connected_components(fingerprint_links(d.select("fp", "node")))
    d_ = d.join(comps.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    lows = d_.groupBy("component").agg(F.min("low").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d_ = materialize(d_.join(lows.hint("merge"), ["component", "salt"]).select(F.col("fp").alias("fp_"), "component_id"), "fingerprint-components")  # written, so adaptive execution can split a hot fingerprint
    out = rows.join(d_.hint("merge"), rows.fp == d_.fp_)
    discard(d, comps)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Rows of a bucket that go to a task together; of a larger one, each two blocks of so many.
BLOCK = 1 << 14
#: Bits of the wide fingerprint, pivots that all buckets try side by side, and what the order of shingles is made of: up to
#: COMMON shingles that OFTEN or more texts of a task's part have. The order changes the work, never the links.
SKETCH, ROUNDS, OFTEN, COMMON = 512, 2, 8, 1 << 17
#: 64-bit words of the sketches that candidates of long texts are also compared by, where a bucket is looked at pair by pair.
MIDDLE = 32
#: Keys of a row, the smallest, by which a pair that meets under several keys is told to have met before.
FIRSTS = 64


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def wide_sketch(shingles: np.ndarray) -> bytes:
    """As sketch(), of a power of two of bits, twice the shingles at least: a wider one folds to a narrower by halves."""
    m = max(SKETCH, 1 << max(0, 2 * len(shingles) - 1).bit_length())
    on = np.bincount((shingles >> np.uint64(17)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(on.astype(np.uint8), bitorder="little").tobytes()


def wide_distance(a: bytes, b: bytes) -> int:
    """Differing bits at the narrower one's width."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    m = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, m), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def middle_sketch(wide: bytes) -> bytes:
    """A wide sketch folded to MIDDLE words at most."""
    x = np.frombuffer(wide, np.uint64)
    return np.bitwise_xor.reduce(x.reshape(-1, min(len(x), MIDDLE)), axis=0).tobytes()


def middle_words(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Middle sketches as rows of MIDDLE words, zeros behind narrower ones, and the words of each."""
    words = np.fromiter((len(x) // 8 for x in sketches), np.int64, len(sketches))
    out = np.zeros((len(sketches), MIDDLE), np.uint64)
    for m in np.unique(words):
        at = np.flatnonzero(words == m)
        out[at, :m] = np.frombuffer(b"".join([sketches[k] for k in at]), np.uint64).reshape(-1, m)
    return out, words


def middle_distance(middle: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of rows i and j, each pair at the narrower one's width."""
    out, width = np.zeros(len(i), np.int64), np.minimum(words[i], words[j])
    for m in np.unique(width):
        at = np.flatnonzero(width == m)
        diff = (middle[i[at]] ^ middle[j[at]]).reshape(len(at), -1, m)
        out[at] = np.bitwise_count(np.bitwise_xor.reduce(diff, axis=1)).sum(-1, dtype=np.int64)
    return out


def packed(shingles: np.ndarray) -> bytes:
    """The low 40 bits of each hash, for the check of a pair: two sets of 1,000 meet by chance once in a million pairs."""
    return np.ascontiguousarray(shingles.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return np.sort(out.view(np.uint64).ravel())


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats; 1 for two empty ones."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set (sorted), as many that sets alike by `similarity` share one of them.

    Such sets share `needed` shingles at least, so they meet in the first n - needed + 1 of any order that is the same for all
    sets. Here it goes by counts, of the shingles in `common` (sorted), and then by hash."""
    n = len(shingles)
    if not n:
        return shingles
    count = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        count = np.where(common[at] == shingles, counts[at], 0)
    needed = int(np.ceil(similarity * n - 1e-9))
    return shingles[np.lexsort((shingles, count))[: n - needed + 1]]


def sketch(shingles: np.ndarray) -> bytes:
    """SKETCH bits, each the parity of the shingles that fall on it: sets differ in no fewer shingles than sketches in bits."""
    on = np.bincount((shingles >> np.uint64(17)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(on.astype(np.uint8), bitorder="little").tobytes()


def may_link(sketches: np.ndarray, sizes: np.ndarray, others: np.ndarray, of_others: np.ndarray, similarity: float) -> np.ndarray:
    """Can sets of these sketches and sizes be alike by `similarity`? Never false if they are."""
    least, most = np.minimum(sizes, of_others), np.maximum(sizes, of_others)
    apart = (1 - similarity) / (1 + similarity) * (sizes + of_others) + 1e-6
    return (least >= similarity * most - 1e-6) & (_distance(sketches, others) <= apart)


def _apart(sizes: np.ndarray, similarity: float) -> int:
    """Bits in which the sketches of two sets of these sizes can differ at most, if the sets are alike by `similarity`."""
    return int(2 * (1 - similarity) / (1 + similarity) * sizes.max(initial=0) + 1e-6)


def _slices(rows: np.ndarray, key: np.ndarray, sizes: np.ndarray):
    """(rows, bucket of each) of whole buckets, those of like radius side by side, the larger first."""
    start, many = _buckets(key[rows])
    most, group = np.maximum.reduceat(sizes[rows], start) if len(rows) else sizes[:0], np.repeat(np.arange(len(start)), many)
    order = np.lexsort((group, -many[group], most[group]))
    rows, group = rows[order], group[order]
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1) != 0), len(rows))
    at = 0
    while at < len(rows):
        end = int(cuts[np.searchsorted(cuts, min(at + (1 << 15), len(rows)))])
        yield rows[at:end], group[at:end]
        at = end


def _linkable(sizes: np.ndarray, sketches: np.ndarray, similarity: float, screen=None):
    """Of pairs (i, j), which may_link(), and pass screen(i, j) if there is one."""

    def linkable(i, j):
        ok = may_link(sketches[i], sizes[i], sketches[j], sizes[j], similarity)
        if screen is not None and ok.any():
            ok[ok] = screen(i[ok], j[ok])
        return ok

    return linkable


def _small_links(rows: np.ndarray, key: np.ndarray, linkable):
    """Yields all pairs (i, j) of one key that are linkable() among rows of small buckets: row k against row k + s for each shift s."""
    _, many = _buckets(key[rows])
    rows = rows[np.argsort(-np.repeat(many, many), kind="stable")]  # later shifts look at the larger buckets only
    s = 1
    while s < len(rows):
        same = np.flatnonzero(key[rows[:-s]] == key[rows[s:]])
        if not len(same):
            return
        for at in range(0, len(same), 1 << 15):
            i, j = rows[same[at : at + (1 << 15)]], rows[same[at : at + (1 << 15)] + s]
            ok = linkable(i, j)
            yield i[ok], j[ok]
        rows, s = rows[: same[-1] + s + 1], s + 1


def _buckets(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one key begin, and their lengths."""
    starts = np.flatnonzero(np.diff(key, prepend=~key[0]) != 0) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def _rounds(mine: np.ndarray, group: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, similarity: float, linkable):
    """Yields links (i, j) that are linkable() from ROUNDS pivots of each bucket, all buckets side by side; last the rows of buckets
    that want more pivots. A bucket's pivots are its first row, then rows reached, then its first row not reached."""
    lanes, n = np.arange(len(mine)), int(group.max()) + 1
    head, after, pivot = np.full(n, -1), np.full(len(mine), -1), np.full(n, -1)
    radius = min(_apart(sizes[mine], similarity), SKETCH)
    for _ in range(ROUNDS):
        here, first = np.unique(group[lanes], return_index=True)
        fresh = head[here] < 0
        pivot[here] = np.where(fresh, lanes[first], head[here])
        head[here] = np.where(fresh, -1, after[pivot[here]])
        lanes = np.delete(lanes, first[fresh])
        if not len(lanes):
            break
        to = pivot[group[lanes]]
        planes = bit_planes(sketches[mine[lanes]] ^ sketches[mine[to]])
        dead = ~_pack(np.ones(len(lanes), bool), planes.shape[1])
        near = _lanes(_within(lambda p, live, planes=planes: planes[p] if live is None else planes[p][live], dead, radius, len(planes)))
        i, j = mine[to[near]], mine[lanes[near]]
        near = near[linkable(i, j)]
        if not len(near):
            continue
        hit = lanes[near]
        yield mine[to[near]], mine[hit]
        of, begin = np.unique(group[hit], return_index=True)
        after[hit[:-1]] = hit[1:]  # what is reached goes before what its bucket has in the queue
        after[hit[np.append(begin[1:], len(hit)) - 1]] = head[of]
        head[of] = hit[begin]
        lanes = np.delete(lanes, near)
    yield mine[np.isin(group, group[lanes])]


def forest_links(key: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, similarity: float, screen=None):
    """Yields links (i, j) between rows of one key (sorted) that may_link(), and pass screen(i, j) if there is one: they join all
    rows that any such links join.

    Sketches are compared bit-sliced, at the radius of the largest sets; what is within it is looked at by its own sizes."""
    _, many = _buckets(key)
    linkable, unfinished = _linkable(sizes, sketches, similarity, screen), []
    for mine, group in _slices(np.flatnonzero(np.repeat(many > 1, many)), key, sizes):
        *links, left = _rounds(mine, group, sizes, sketches, similarity, linkable)
        yield from links
        unfinished.append(left)
    rows = np.sort(np.concatenate(unfinished)) if unfinished else np.zeros(0, np.int64)
    starts, many = _buckets(key[rows])
    yield from _small_links(rows[np.repeat(many <= SMALL, many)], key, linkable)
    for g in np.flatnonzero(many > SMALL):
        mine = rows[starts[g] : starts[g] + many[g]]
        i, j = pivot_links(sketches[mine], min(_apart(sizes[mine], similarity), SKETCH), lambda p, to, mine=mine: linkable(np.full(len(to), mine[p]), mine[to]))
        yield mine[i], mine[j]


def crossing_links(key: np.ndarray, component: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, similarity: float):
    """Yields all pairs (i, j) of rows of one key (sorted) that may_link() and are of different components."""
    starts, many = _buckets(key)
    for i, j in _small_links(np.flatnonzero(np.repeat((many > 1) & (many <= SMALL), many)), key, _linkable(sizes, sketches, similarity)):
        apart = component[i] != component[j]
        yield i[apart], j[apart]
    for g in np.flatnonzero(many > SMALL):
        a, z = starts[g], starts[g] + many[g]
        _, of, of_each = np.unique(component[a:z], return_inverse=True, return_counts=True)
        rows = a + np.lexsort((of, of_each[of]))  # the largest component last: its rows meet those before only
        comp, size, sk = component[rows], sizes[rows], sketches[rows]
        planes, n, radius = bit_planes(sk), z - a, min(_apart(size, similarity), SKETCH)
        for p in range(0, int(n - of_each.max()), 64):
            k = min(64, int(n - of_each.max()) - p)
            valid = np.zeros(planes.shape[1] * 64, bool)
            valid[p:n] = True
            dead = np.repeat(~_pack(valid, planes.shape[1])[None], k, axis=0)
            sign = np.unpackbits(np.ascontiguousarray(sk[p : p + k]).view(np.uint8).reshape(k, -1), axis=1, bitorder="little").astype(np.uint64) * _ONES
            got = _within(lambda b, live, sign=sign: planes[b][None] ^ sign[:, b][:, None] if live is None else planes[b][live[1]] ^ sign[live[0], b], dead, radius, len(planes))
            for x in range(k):
                j = _lanes(got[x])
                j = j[(j > p + x) & (comp[j] != comp[p + x])]
                j = j[may_link(sk[p + x], size[p + x], sk[j], size[j], similarity)]
                yield np.full(len(j), rows[p + x]), rows[j]


def narrowed(middle: np.ndarray) -> np.ndarray:
    """Middle sketches as sketches of SKETCH bits."""
    return np.bitwise_xor.reduce(middle.reshape(len(middle), -1, SKETCH // 64), axis=1)


def middle_screen(sizes: np.ndarray, middle: np.ndarray, words: np.ndarray, similarity: float):
    """Of pairs (i, j), which may link by their middle sketches: all that are alike by `similarity` pass.

    A sketch of SKETCH bits says nothing of long texts, which all buckets of a frequent passage hold, so they are compared by
    bits in proportion to their shingles before they leave the task."""
    return lambda i, j: middle_distance(middle, words, i, j) <= (1 - similarity) / (1 + similarity) * (sizes[i] + sizes[j]) + 1e-6


def screened_links(key: np.ndarray, component: np.ndarray, sizes: np.ndarray, middle: np.ndarray, words: np.ndarray, similarity: float):
    """Yields all pairs (i, j) of rows of one key (sorted) that are of different components and pass middle_screen()."""
    screen = middle_screen(sizes, middle, words, similarity)
    for i, j in crossing_links(key, component, sizes, narrowed(middle), similarity):
        may = screen(i, j)
        if may.any():
            yield i[may], j[may]


def first_meetings(i: np.ndarray, j: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Of pairs (i, j) of one key, those that meet under no smaller key; firsts has smaller keys of each row.

    A list may leave keys out: pairs then come more than once, and under their smallest key in any case."""
    rows = {k: frozenset(firsts[k]) for k in np.unique(np.concatenate([i, j])).tolist()}
    return np.fromiter((rows[a].isdisjoint(rows[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))


def signed_buckets(batches):
    """Passes on batches of rows (key, node) sorted by key, and adds a row for each key, without a node, that signs its set of
    nodes: their number and two sums of hashes, 128 bits, equal for equal sets. Only the sums of the last key are held."""
    names, held = ["key", "node", "n", "low", "high"], None

    def signs(of):
        return pa.RecordBatch.from_arrays([pa.array(of[0]), pa.nulls(len(of[0]), pa.int64()), *[pa.array(x.view(np.int64)) for x in of[1:]]], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        none = pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), none, none, none], names=names)
        key, node = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        starts, many = _buckets(key)
        new = [key[starts], many.astype(np.uint64), np.add.reduceat(mix64(node), starts), np.add.reduceat(mix64(~node), starts)]
        if held is not None and held[0][0] == key[0]:
            for x, y in zip(new[1:], held[1:], strict=True):
                x[:1] += y
        elif held is not None:
            new = [np.concatenate(x) for x in zip(held, new, strict=True)]
        held = [x[-1:].copy() for x in new]
        if len(new[0]) > 1:
            yield signs([x[:-1] for x in new])
    if held is not None:
        yield signs(held)


def _whole_keys(batches, columns):
    """Columns of rows sorted by the first, as arrays that hold every row of a key; columns(batch) gives the arrays."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        got = columns(b)
        if rows >= 1 << 15:
            last = got[0] != held[-1][0][-1]
            cut = int(np.argmax(last)) if last.any() else len(last)  # how far the last key goes on
            held.append([x[:cut] for x in got])
            if cut == len(last):
                rows += cut
                continue
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, rows, got = [], 0, [x[cut:] for x in got]
        held.append(got)
        rows += len(got[0])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _once(batches):
    """(node, texts) of batches of node, text; a node that follows itself, as a repeated row does, is left out."""
    last = None
    for b in batches:
        node = b.column(0).to_numpy()
        if not len(node):
            continue
        new = np.append(last is None or node[0] != last, node[1:] != node[:-1])
        last = node[-1]
        yield node[new], b.column(1).filter(pa.array(new)).to_pylist()


def in_blocks(buckets: DataFrame) -> DataFrame:
    """buckets (key, node, ...) with `task`: the key, but where a key has more than BLOCK rows, each two of its blocks are a task.

    So every two rows of a key meet in one task, and no task holds more than about two blocks of a key."""
    hot = materialize(buckets.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("shares")), "hot")  # a row for BLOCK rows
    if hot.isEmpty():
        discard(hot)
        return buckets.withColumn("task", F.col("key"))
    cool = buckets.join(hot, "key", "left_anti").withColumn("task", F.col("key"))
    b = F.pmod(F.xxhash64("node", F.lit(5)), F.col("shares")).cast("int")
    dealt = buckets.join(hot, "key").withColumn("b", b).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return cool.unionByName(dealt.withColumn("task", F.xxhash64("key", F.least("b", "c"), F.greatest("b", "c"))).drop("b", "c", "shares"))


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_hash, component_id, kept, n: a row for each doc_id and text, n times in docs.

    component_id: the smallest doc_id reached by links of verified similarity; kept: is it the row that stands for its group?
    Equal sets of shingles are one node. A link holds if the Jaccard similarity of two sets of shingle hashes is `similarity` or
    more. A node's wide fingerprint has the parity of its shingles on each bit where a SimHash has the majority, as two sets
    then differ in no fewer shingles than fingerprints in bits: no link is lost to the radius. Candidates share a shingle of
    their prefixes, which two sets so alike always do, and are compared bit-sliced; of buckets of the same nodes one is looked at. Of each bucket a forest of the candidates
    is verified on the sets; where a link of it does not hold, so are all candidates of the bucket between groups still apart.
    So the groups are those of all pairs, at any size of group.
    Defined results: null, empty and blank texts are alike; of rows with one doc_id and different texts each is a row of its
    own; a group is stood for by its smallest doc_id (then by the hash of the text), by a null id only if there is no other;
    an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.col("text").cast("string"))

    def prints(batches):
        seen, n = [], 0

        def counted():
            token, count = np.unique(np.concatenate(seen), return_counts=True)
            token, count = token[count >= OFTEN], count[count >= OFTEN]
            none = pa.nulls(len(token))
            return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(token.view(np.int64)), pa.array(count)], names=names)

        names = ["doc_id", "text_hash", "digest", "token", "n"]
        for b in batches:
            sets = []
            for t in b.column(2).to_pylist():
                h = np.unique(shingle_hashes(t, words))
                sets.append(xxhash.xxh128_digest(h.tobytes()))
                seen.append(h)
                n += len(h)
                if n >= 1 << 21:
                    yield counted()
                    seen, n = [], 0
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary()), none, none], names=names)
        if seen:
            yield counted()

    told = materialize(texts.mapInArrow(prints, "doc_id long, text_hash long, digest binary, token long, n long"), "sets")
    rows = told.where("digest is not null").groupBy("doc_id", "text_hash", "digest").agg(F.count("*").alias("n"))
    often = told.where("digest is null").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(COMMON).collect()
    common, counts = np.array([r[0] for r in often], np.int64).view(np.uint64), np.array([r[1] for r in often], np.int64)
    order = np.argsort(common)
    held = spark.sparkContext.broadcast((common[order], counts[order]))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    d = told.where("digest is not null").groupBy("digest").agg(first)
    d = materialize(d.select("digest", "first.doc_id", "first.text_hash").withColumn("node", F.monotonically_increasing_id()), "distinct-sets")

    def of_nodes(made, nodes):
        """made (doc_id, text_hash, ...) -> node, ... of the nodes, whose first rows these are; a node as often as its row is there."""
        wanted = nodes.select("node", F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"))
        return made.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).drop("doc_id", "text_hash", "first_id", "first_hash")

    def deal(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                keys = [prefix(np.unique(shingle_hashes(t, words)), similarity, *held.value).view(np.int64) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "keys"])

    def shared(batches):
        """Of rows sorted by key and node, those whose key another node has too, each once. Held is the last row alone."""
        last = None  # key, node, has another node come with this key?
        for b in batches:
            key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            if last is not None:
                key, node = np.append(last[0], key), np.append(last[1], node)
            once = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node = key[once], node[once]
            if not len(key):
                continue
            before = np.append(last is not None and last[2], key[1:] == key[:-1])
            keep = before | np.append(key[1:] == key[:-1], False)
            last = key[-1], node[-1], bool(before[-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep[:-1]]), pa.array(node[:-1][keep[:-1]])], names=["key", "node"])
        if last is not None and last[2]:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], names=["key", "node"])

    made = texts.mapInArrow(deal, "doc_id long, text_hash long, keys array<long>")
    every = of_nodes(made, d).select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    signed = materialize(every.mapInArrow(lambda batches: signed_buckets(shared(batches)), "key long, node long, n long, low long, high long"), "signed")
    collect_garbage(spark)
    # Keys with the same nodes, as the shingles of a shared passage have, give the same pairs: one of them stays.
    own = signed.where("node is null").groupBy("n", "low", "high").agg(F.min("key").alias("key")).select("key")
    dealt = materialize(signed.where("node is not null").select("key", "node").join(own.hint("merge"), "key", "left_semi"), "dealt")
    discard(signed)
    collect_garbage(spark)

    def sets(batches):
        for node, some in _once(batches):
            for at in range(0, len(some), 500):
                h = [np.unique(shingle_hashes(t, words)) for t in some[at : at + 500]]
                wide = [wide_sketch(x) for x in h]
                yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 500]), pa.array([len(x) for x in h], pa.int32()), pa.array(wide, pa.binary()), pa.array(map(middle_sketch, wide), pa.binary()), pa.array([packed(x) for x in h], pa.binary())], names=["node", "size", "wide", "middle", "shingles"])

    known = of_nodes(texts, dealt.select("node").distinct().join(d, "node")).select("node", "text").mapInArrow(sets, "node long, size int, wide binary, middle binary, shingles binary")
    known = materialize(known.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "wide", "middle", "shingles")]), "shingles")  # the same row twice has equal sets
    collect_garbage(spark)
    buckets = in_blocks(dealt).join(known.select("node", "size", "middle").hint("merge"), "node").select("task", "key", "node", "size", "middle")

    def columns(b):
        return [*[b.column(k).to_numpy() for k in range(3)], b.column(3).to_numpy().astype(np.int64), *middle_words(b.column(4).to_pylist())]

    def pairs(a, z, *more, names=("a", "b")):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z)), *more], names=list(names))

    def candidates(batches):
        for task, key, node, size, middle, wide in _whole_keys(batches, columns):
            for i, j in forest_links(task, size, narrowed(middle), similarity, middle_screen(size, middle, wide, similarity)):
                if len(i):
                    yield pairs(node[i], node[j], pa.array(key[i]), names=("a", "b", "key"))

    links = buckets.repartition("task").sortWithinPartitions("task", "node").mapInArrow(candidates, "a long, b long, key long")
    links = materialize(links.distinct(), "candidates")
    collect_garbage(spark)

    def verify(batches):
        for b in batches:
            a, z = ([unpacked(x) for x in b.column(k).to_pylist()] for k in (2, 3))
            holds = [similarity_of(x, y) >= similarity for x, y in zip(a, z, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(holds, pa.bool_())], names=["a", "b", "holds"])

    def screen(batches):
        for b in batches:
            a, z = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            d = np.array([wide_distance(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d <= (1 - similarity) / (1 + similarity) * (a + z) + 1e-6)], names=["a", "b", "may"])

    def joined(pairs, *columns):
        """pairs (a, b) with columns of a, then of b."""
        for side in ("a", "b"):
            pairs = pairs.join(known.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]).hint("merge"), side)
        return pairs.select("a", "b", *[f"{c}_{side}" for c in columns for side in ("a", "b")])

    def verified(pairs):
        """pairs (a, b) -> a, b, holds. Wide sketches, a tenth of the sets, screen first and part no link; then the sets decide."""
        screened = materialize(joined(pairs, "size", "wide").mapInArrow(screen, "a long, b long, may boolean"), "screened")
        collect_garbage(spark)
        holds = joined(screened.where("may").select("a", "b"), "shingles").mapInArrow(verify, "a long, b long, holds boolean")
        out = materialize(holds.union(screened.where("not may")), "verified")
        discard(screened)
        return out

    tested = [verified(links.select("a", "b").distinct())]
    collect_garbage(spark)
    comps = connected_components(tested[0].where("holds").select("a", "b"))
    # A forest's link that does not hold leaves pieces apart that other pairs of its bucket may join: all those are tested.
    failed = materialize(links.join(tested[0].where("not holds"), ["a", "b"]).select("key").distinct(), "failed")
    if not failed.isEmpty():
        again = dealt.join(failed.hint("merge"), "key", "left_semi")
        firsts = again.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("key")), 1, FIRSTS).alias("firsts"))  # no more keys than a prefix has
        apart = in_blocks(again).join(known.select("node", "size", "middle").join(firsts.hint("merge"), "node").hint("merge"), "node")
        apart = apart.join(comps.hint("merge"), "node", "left")
        before = F.filter("firsts", lambda k: k < F.col("key")).alias("before")
        apart = apart.select("task", "key", "node", "size", "middle", F.coalesce("component", "node").alias("component"), before)

        def listed(b):
            lists = np.empty(b.num_rows, object)
            for k, keys in enumerate(b.column(6).to_pylist()):
                lists[k] = keys
            return [*columns(b), b.column(5).to_numpy(), lists]

        def crossing(batches):
            for task, _, node, size, middle, wide, comp, before in _whole_keys(batches, listed):
                for i, j in screened_links(task, comp, size, middle, wide, similarity):
                    new = first_meetings(i, j, before)
                    if new.any():
                        yield pairs(node[i[new]], node[j[new]])

        more = apart.repartition("task").sortWithinPartitions("task", "node").mapInArrow(crossing, "a long, b long").distinct()
        tested.append(verified(more.join(tested[0].hint("merge"), ["a", "b"], "left_anti")))
        both = tested[0].union(tested[1]).where("holds").select("a", "b")
        discard(comps)
        comps = connected_components(both)
    whole = smallest(d.join(comps.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    out = rows.join(whole.withColumnRenamed("digest", "digest_").hint("merge"), F.col("digest") == F.col("digest_"))
    kept = F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("text_hash") == F.col("low.text_hash"))
    out = materialize(out.select("doc_id", "text_hash", F.col("low.doc_id").alias("component_id"), kept.alias("kept"), "n"), "near-groups")
    discard(told, d, dealt, known, links, failed, comps, *tested)
    return out


def smallest(d: DataFrame) -> DataFrame:
    """d (digest, doc_id, text_hash, component) -> digest, low: the row that stands for the component, null ids last.

    A component of many nodes is summed in parts, and its row goes back to as many parts."""
    d = d.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    lows = d.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("low"))
    lows = lows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return d.join(lows.hint("merge"), ["component", "salt"]).select("digest", "low")


def text_hash():
    """What tells texts of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))
