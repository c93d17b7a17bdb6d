"""Document fingerprints as invertible Bloom lookup sketches of paragraph pieces."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import Buffer, chunks
from .common import materialize, mix64

#: Cells of the sketch that the fingerprint shows; larger sketches are made when subtracting does not peel.
CELLS = 12
#: A paragraph is cut after words whose hash is 0 modulo this, so edits change few pieces however long its lines are.
PIECE = 4
#: Bytes of text that one range of ids aims at.
RANGE_BYTES = 24 << 20
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of each text's paragraph pieces: (owner, digest), sorted by both."""
    b = Buffer(texts)
    if not len(b.start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lines = np.cumsum(b.bytes == 10)
    cut = b.hash(b.start, b.end) % np.uint64(PIECE) == 0
    cut[:-1] |= lines[b.start[1:]] != lines[b.end[:-1] - 1]
    cut[-1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    owner, digest = b.owner[first], b.hash(b.start[first], b.end[last])
    order = np.lexsort((digest, owner))
    owner, digest = owner[order], digest[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
    return owner[new], digest[new]


class Sketches:
    """Sketches of n sets side by side; sketch k has cells[k] cells in three parts, a digest has one cell in each part."""

    def __init__(self, cells: np.ndarray, seed: int = 0):
        self.third = np.maximum(1, -(-np.asarray(cells, np.int64) // 3))
        self.base = np.concatenate([[0], np.cumsum(3 * self.third)])
        self.seed = np.uint64(seed)
        self.count = np.zeros(self.base[-1], np.int64)
        self.key, self.check = np.zeros(self.base[-1], np.uint64), np.zeros(self.base[-1], np.uint64)

    def places(self, owner, digest):
        with np.errstate(over="ignore"):
            h = mix64(digest ^ mix64(self.seed + np.uint64(1)))
        third = self.third[owner].astype(np.uint64)
        for part, shift in enumerate((0, 21, 42)):
            yield self.base[owner] + part * self.third[owner] + ((h >> np.uint64(shift)) & np.uint64(0x1FFFFF)).astype(np.int64) % third.astype(np.int64)

    def add(self, owner, digest, sign):
        """Insert (sign 1) or subtract (sign -1; a number or one for each digest)."""
        check = mix64(digest ^ _CHECK)
        sign = np.broadcast_to(np.asarray(sign, np.float64), owner.shape)
        for at in self.places(owner, digest):
            self.count += np.bincount(at, sign, len(self.count)).astype(np.int64)
            np.bitwise_xor.at(self.key, at, digest)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recover what is in the sketches: owner, digest, sign, and whether each sketch came out empty."""
        n = len(self.third)
        of = np.repeat(np.arange(n), 3 * self.third)
        got: list[tuple] = []
        look = np.arange(len(self.count))
        while True:
            pure = look[np.abs(self.count[look]) == 1]
            pure = pure[mix64(self.key[pure] ^ _CHECK) == self.check[pure]]
            if not len(pure):
                break
            order = np.lexsort((self.key[pure], of[pure]))
            pure = pure[order]
            new = np.ones(len(pure), bool)
            new[1:] = (of[pure][1:] != of[pure][:-1]) | (self.key[pure][1:] != self.key[pure][:-1])
            pure = pure[new]
            owner, digest, sign = of[pure], self.key[pure], self.count[pure]
            got.append((owner, digest, sign))
            look = np.unique(np.concatenate(list(self.places(owner, digest))))
            self.add_signed(owner, digest, -sign)
        full = np.zeros(n, bool)
        full[of[(self.count != 0) | (self.key != 0) | (self.check != 0)]] = True
        owner, digest, sign = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, t) for k, t in enumerate((np.int64, np.uint64, np.int64)))
        return owner, digest, sign, ~full

    def add_signed(self, owner, digest, sign):
        check = mix64(digest ^ _CHECK)
        for at in self.places(owner, digest):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, digest)
            np.bitwise_xor.at(self.check, at, check)

    def strings(self) -> list[str]:
        """Each sketch as hex: for each cell its count, digest sum and check sum."""
        cell = np.zeros((len(self.count), 14), np.uint8)
        cell[:, :2] = self.count.astype(">u2").view(np.uint8).reshape(-1, 2)
        cell[:, 2:10] = self.key.astype(">u8").view(np.uint8).reshape(-1, 8)
        cell[:, 10:] = (self.check & np.uint64(0xFFFFFFFF)).astype(">u4").view(np.uint8).reshape(-1, 4)
        raw = cell.tobytes()
        return [raw[14 * a : 14 * z].hex() for a, z in zip(self.base[:-1].tolist(), self.base[1:].tolist(), strict=True)]


def sketch(n: int, owner, digest, cells=CELLS, seed=0) -> Sketches:
    s = Sketches(np.broadcast_to(cells, n), seed)
    s.add(owner, digest, 1)
    return s


def differences(n: int, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of which one of two versions lacks the other's: (owner, digest, sign), sign 1 if only in a, -1 if only in b.

    a, b: (owner, digest) of n pairs of versions. Sketches are subtracted and peeled; pairs that leave anything behind are
    retried with four times the cells, then with enough for all their digests, then larger with other hashes."""
    size = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)
    cells, seed = np.full(n, CELLS), 0
    left = np.flatnonzero(size)
    out = []
    while len(left):
        to = np.full(n, -1)
        to[left] = np.arange(len(left))
        s = Sketches(cells[left], seed)
        for (owner, digest), sign in ((a, 1), (b, -1)):
            mine = to[owner] >= 0
            s.add(to[owner[mine]], digest[mine], sign)
        owner, digest, sign, empty = s.peel()
        keep = empty[owner]
        out.append((left[owner[keep]], digest[keep], sign[keep]))
        left = left[~empty]
        enough = 2 * size + 24
        cells = np.where(cells < 4 * CELLS, np.minimum(4 * CELLS, np.maximum(enough, CELLS + 3)), np.where(cells < enough, enough, 2 * cells))
        seed += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def likeness(n: int, a: tuple, b: tuple) -> np.ndarray:
    """Share of the digests of either version that both have; 1 for two versions without digests."""
    owner, _, sign = differences(n, a, b)
    only_a, only_b = np.bincount(owner[sign > 0], minlength=n), np.bincount(owner[sign < 0], minlength=n)
    in_a = np.bincount(a[0], minlength=n)
    either = in_a + only_b
    return np.where(either > 0, (in_a - only_a) / np.maximum(either, 1), 1.0)


def edited(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(texts: list[str], following: list[str]) -> dict[str, list]:
    """Columns of the result for texts and the texts that follow them."""
    out: dict[str, list] = {k: [] for k in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    for a, z in chunks(texts, 1 << 18):
        n = z - a
        new = [edited(t, f).encode() for t, f in zip(texts[a:z], following[a:z], strict=True)]
        mine, theirs, other = pieces([t.encode() for t in texts[a:z]]), pieces(new), pieces([t.encode() for t in following[a:z]])
        out["n_chars"] += [len(t) for t in texts[a:z]]
        out["edited_sha256"] += [hashlib.sha256(t).hexdigest() for t in new]
        out["fingerprint"] += sketch(n, *mine).strings()
        out["edited_fingerprint"] += sketch(n, *theirs).strings()
        out["near_edited"] += likeness(n, mine, theirs).tolist()
        out["near_next"] += likeness(n, mine, other).tolist()
    return out


_COLUMNS = [("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"), ("fingerprint", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"), ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double")]
_SCHEMA = "doc_id long, " + ", ".join(f"{k} {t}" for k, _, t in _COLUMNS)


def _told(ids: list, texts: list, following: list) -> list[pa.Array]:
    got = compare(texts, following)
    return [pa.array(ids, pa.int64()), *(pa.array(got[k], t) for k, t, _ in _COLUMNS)]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The following document is the next in descending doc_id; after the last comes the first. Rows are dealt into ranges of ids
    by one exchange, and each range is sorted and read as a stream. Its first text and its last row, which the next range's
    first text follows, are told apart and meet afterwards. Likeness is the share of common paragraph pieces, from subtracting
    and peeling sketches. A fingerprint shows 16 bits of a cell's count and 32 of its check sum; the likeness comes from whole ones.
    Defined results: null text is empty; null ids come last; rows with one id, and those without, follow in order of a hash of
    the text; a single row follows itself; an empty table gives no rows; other columns are ignored. Texts without words have
    an empty sketch, likeness 1 to each other and 0 to others."""
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").desc()]
    d = d.repartitionByRange(max(1, size // RANGE_BYTES + 1), *order).sortWithinPartitions(*order)
    names = ["doc_id", *(k for k, _, _ in _COLUMNS), "part", "head", "tail"]

    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), None  # the last row has not been told: (id, text)
        for b in batches:
            for a in range(0, b.num_rows, 250):
                ids, texts = (b.column(k).slice(a, 250).to_pylist() for k in range(2))
                if before is None:
                    yield edge(part, None, texts[0], None)
                else:
                    ids, texts = [before[0], *ids], [before[1], *texts]
                before = ids[-1], texts[-1]
                if len(ids) > 1:
                    none = pa.nulls(len(ids) - 1)
                    yield pa.RecordBatch.from_arrays([*_told(ids[:-1], texts[:-1], texts[1:]), none.cast(pa.int32()), none.cast(pa.string()), none.cast(pa.string())], names=names)
        if before is not None:
            yield edge(part, before[0], None, before[1])

    def edge(part, i, head, tail):
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *(pa.nulls(1, t) for _, t, _ in _COLUMNS), pa.array([part], pa.int32()), pa.array([head], pa.string()), pa.array([tail], pa.string())], names=names)

    found = materialize(d.select("doc_id", "text").mapInArrow(run, _SCHEMA + ", part int, head string, tail string"), "edits", "zstd")  # hex digits take half the room
    # Two rows for each range: the last row of a range is followed by the first text of the next range that has rows.
    parts = sorted(r["part"] for r in found.where("head is not null").select("part").collect())
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, to int")
    heads = found.where("head is not null").select(F.col("part").alias("to"), F.col("head").alias("following"))
    ends = found.where("tail is not null").select("doc_id", F.col("tail").alias("text"), "part").join(after, "part").join(heads, "to")

    def last(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(_told(*(b.column(k).to_pylist() for k in range(3))), names=names[:7])

    return found.where("part is null").select(names[:7]).unionByName(ends.select("doc_id", "text", "following").mapInArrow(last, _SCHEMA))
