"""SentencePiece encoding and decoding: Viterbi over the piece lattice, and N-best by backward A-star search."""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_M = np.uint64(0x9E3779B97F4A7C15)
#: Numbers of an index over prefixes, as a power of two.
BITS = 19


class Pieces:
    """Pieces of a vocabulary file, with a log probability each; `▁` at the start of pieces stands for a space here.

    The file holds merge ranks, not probabilities, and nothing is trained here: the piece of rank r gets
    -ln(r + 2.7) - ln(sum over all ranks of 1 / (r + 2.7)), Zipf's law. A character without a piece of its own is its UTF-8
    bytes, each worth the least score less 10."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of, names, bytes_at = [], [], {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_at[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                names.append((p.replace("▁", " "), i))
                self.bytes_of.append(names[-1][0].encode())
        if len(bytes_at) < 256:
            raise ValueError("the vocabulary needs a piece for each byte")
        rank = np.arange(len(names)) + 2.7
        logs = -np.log(rank) - np.log((1 / rank).sum())
        self.ids = {p: i for p, i in names}
        self.score = np.zeros(len(self.bytes_of))
        for (_, i), s in zip(names, logs, strict=True):
            self.score[i] = s
        self.byte_score = float(logs.min()) - 10
        self.byte_ids = np.array([bytes_at[b] for b in range(256)], np.int32)
        self.score[self.byte_ids] = self.byte_score
        self.longest = max(map(len, self.ids))
        self.singles = {p for p in self.ids if len(p) == 1}
        # Text can be cut before spaces, and at characters of no longer piece, if no piece goes across.
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        own = "".join(c for c in "\n\r\t" if c not in inner)
        across = any(" " in p.lstrip(" ") for p in self.ids)
        self.chunk = None if across else re.compile(rf"[{own}]| *[^ {own}]+| +" if own else r" *[^ ]+| +")
        self._index()

    def _index(self):
        """Open-addressed table of the hashes of all beginnings of pieces: the piece's id, or -1 for a beginning only."""
        known: dict[int, int] = {}
        for p, i in self.ids.items():
            h = 0
            for k, c in enumerate(p):
                h = (h * int(_M) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                if k + 1 == len(p):
                    if known.get(h, -1) >= 0:
                        raise ValueError("two pieces have one hash")
                    known[h] = i
                else:
                    known.setdefault(h, -1)
        self.slot_hash, self.slot_id = np.zeros(1 << BITS, np.uint64), np.full(1 << BITS, -2, np.int32)
        for h, i in known.items():
            s = (h * int(_M) & 0xFFFFFFFFFFFFFFFF) >> (64 - BITS)
            while self.slot_id[s] != -2:
                s = (s + 1) & ((1 << BITS) - 1)
            self.slot_hash[s], self.slot_id[s] = h, i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Id of the piece with each hash; -1 for a beginning, -2 for neither."""
        out = np.full(len(h), -2, np.int32)
        slot, left = (h * _M >> np.uint64(64 - BITS)).astype(np.int64), np.arange(len(h))
        while len(left):
            got = self.slot_id[slot]
            hit = (self.slot_hash[slot] == h[left]) & (got != -2)
            out[left[hit]] = got[hit]
            go = ~hit & (got != -2)
            left, slot = left[go], (slot[go] + 1) & ((1 << BITS) - 1)
        return out

    def chunks(self, text: str) -> list[str]:
        text = " " + text
        return self.chunk.findall(text) if self.chunk else [text]

    def decode(self, ids) -> str:
        """Text of pieces: bytes of all pieces end to end, less the space that encoding puts in front."""
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode()


def lattice(text: str, pieces: Pieces) -> list[list[tuple[int, float, int]]]:
    """For each end position: (start, score, id) of the pieces that end there, longest first; id -1 for a character's bytes."""
    out = [[] for _ in range(len(text) + 1)]
    for a in range(len(text)):
        if text[a] not in pieces.singles:
            out[a + 1].append((a, len(text[a].encode()) * pieces.byte_score, -1))
        for z in range(a + 1, min(len(text), a + pieces.longest) + 1):
            i = pieces.ids.get(text[a:z])
            if i is not None:
                out[z].append((a, float(pieces.score[i]), i))
    return out


def nbest(text: str, n: int, pieces: Pieces) -> list[tuple[float, list[int]]]:
    """The n best segmentations, best first: (score, ids).

    Forward Viterbi gives the best score from the start to each position. It is the exact rest of the way for a search from
    the end, so A-star takes each partial path in order of the best whole path through it, and the first n that arrive are
    the n best."""
    ends = lattice(text, pieces)
    best = [0.0] + [-np.inf] * len(text)
    for z in range(1, len(text) + 1):
        best[z] = max((best[a] + s for a, s, _ in ends[z]), default=-np.inf)
    # of equal totals (but for rounding) the path nearest the start goes on: else ties in runs of one letter are walked all at once
    step = 1e-9 + 1e-10 * abs(best[-1])
    heap: list = [(round(-best[-1] / step), len(text), 0, -best[-1], 0.0, None)]
    out, made = [], 0
    while heap and len(out) < n:
        _, at, _, total, done, path = heapq.heappop(heap)
        if at == 0:
            ids = []
            while path is not None:
                (a, z, i), path = path
                ids += [i] if i >= 0 else pieces.byte_ids[list(text[a:z].encode())].tolist()
            out.append((-total, ids))
            continue
        for a, s, i in ends[at]:
            made += 1
            total = -(best[a] + s + done)
            heapq.heappush(heap, (round(total / step), a, made, total, done + s, ((a, at, i), path)))
    return out


class Segmented:
    """Best segmentations of many chunks side by side: score, gap to the second best (inf if none), ids in order."""

    def __init__(self, chunks: list[str], pieces: Pieces):
        n = len(chunks)
        size = np.fromiter(map(len, chunks), np.int64, n)
        first = np.concatenate([[0], np.cumsum(size + 1)])
        x = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le"), np.uint32)  # position p of the text is node p
        offset = np.arange(len(x)) - np.repeat(first[:-1], size + 1)
        room = np.repeat(size, size + 1) - offset
        starts, lengths, ids = [], [], []
        alive = np.flatnonzero(room > 0)
        h, single = np.zeros(len(alive), np.uint64), np.zeros(len(x), bool)
        for k in range(1, pieces.longest + 1):
            if not len(alive):
                break
            h = h * _M + x[alive + k - 1].astype(np.uint64) + np.uint64(1)
            got = pieces.find(h)
            hit = got >= 0
            starts.append(alive[hit]), lengths.append(np.full(int(hit.sum()), k)), ids.append(got[hit])
            if k == 1:
                single[alive[hit]] = True
            go = (got != -2) & (room[alive] > k)
            alive, h = alive[go], h[go]
        bare = np.flatnonzero(~single & (room > 0))
        width = 1 + (x[bare] > 0x7F) + (x[bare] > 0x7FF) + (x[bare] > 0xFFFF)
        start = np.concatenate([*starts, bare]).astype(np.int64)
        length = np.concatenate([*lengths, np.ones(len(bare), np.int64)]).astype(np.int64)
        piece = np.concatenate([*ids, np.full(len(bare), -1)]).astype(np.int64)
        score = np.concatenate([pieces.score[piece[: len(piece) - len(bare)]], width * pieces.byte_score])
        end = start + length
        self.score, self.gap, edges = self._best(n, first, size, offset, start, end, length, score)
        # ids of the best paths, bytes written out
        chunk, at = edges
        p = piece[at]
        char = x[start[at]].astype(np.int64)
        wide = np.where(p >= 0, 1, 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF))
        each = np.repeat(np.arange(len(p)), wide)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(wide) - wide, wide)
        self.ids = p[each]
        byte = self.ids < 0
        c, w, k = char[each][byte], wide[each][byte], nth[byte]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[w]
        value = np.where(w == 1, c, np.where(k == 0, lead | (c >> (6 * (w - 1))), 0x80 | ((c >> (6 * np.maximum(w - 1 - k, 0))) & 0x3F)))
        self.ids[byte] = pieces.byte_ids[value]
        self.count = np.bincount(chunk, wide, n).astype(np.int64)
        self.begin = np.cumsum(self.count) - self.count

    @staticmethod
    def _best(n, first, size, offset, start, end, length, score):
        nodes = len(offset)
        alpha, beta = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
        head, tail = first[:-1], first[:-1] + size
        alpha[head], beta[tail] = 0.0, 0.0
        order = np.lexsort((-length, end, offset[end]))
        s, z, w = start[order], end[order], score[order]
        level = np.searchsorted(offset[z], np.arange(1, size.max(initial=0) + 2))
        new = np.flatnonzero(np.diff(z, prepend=-1))
        groups = np.searchsorted(new, level)
        from_edge = np.full(nodes, -1, np.int64)
        for k in range(len(level) - 1):
            a, b = level[k], level[k + 1]
            if a == b:
                continue
            cand = alpha[s[a:b]] + w[a:b]
            at = new[groups[k] : groups[k + 1]] - a
            top = np.maximum.reduceat(cand, at)
            nodes_here = z[a + at]
            alpha[nodes_here] = top
            width = np.diff(np.append(at, b - a))
            equal = np.flatnonzero(cand == np.repeat(top, width))
            where = z[a + equal]
            keep = np.concatenate([[True], where[1:] != where[:-1]])  # the longest of equal ones
            from_edge[where[keep]] = a + equal[keep]
        back = np.lexsort((start, -offset[start]))
        sb, zb, wb = start[back], end[back], score[back]
        deepest = int(offset[sb[0]]) if len(sb) else 0
        level = np.searchsorted(-offset[sb], -np.arange(deepest, -2, -1))
        new = np.flatnonzero(np.diff(sb, prepend=-1))
        groups = np.searchsorted(new, level)
        for k in range(len(level) - 1):
            a, b = level[k], level[k + 1]
            if a < b:
                at = new[groups[k] : groups[k + 1]] - a
                beta[sb[a + at]] = np.maximum.reduceat(beta[zb[a:b]] + wb[a:b], at)
        # walk back along the best paths
        at, who = tail.copy(), np.arange(n)
        chunk, edge = [], []
        on = np.zeros(len(s), bool)
        while True:
            go = at > head[who]
            at, who = at[go], who[go]
            if not len(at):
                break
            e = from_edge[at]
            on[e] = True
            chunk.append(who), edge.append(e)
            at = s[e]
        chunk, edge = (np.concatenate(v)[::-1] if v else np.zeros(0, np.int64) for v in (chunk, edge))
        sort = np.argsort(chunk, kind="stable")
        total = alpha[tail]
        # a second path has an edge off the best one: the best way through such an edge
        of = np.searchsorted(first, s[~on], side="right") - 1
        gap = np.full(n, np.inf)
        np.minimum.at(gap, of, total[of] - (alpha[s[~on]] + w[~on] + beta[z[~on]]))
        return total, np.maximum(gap, 0.0), (chunk[sort], order[edge[sort]])


class _Index(dict):
    """Numbers chunks as they come."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


class Encoder:
    """Encodes documents: chunks that come again in a call, or are among the first KEPT, are segmented once."""

    KEPT, SLICE = 100_000, 16_384

    def __init__(self, pieces: Pieces, best: int = 4):
        self.pieces, self.best, self.seen = pieces, best, {}
        self.index, self.names = _Index(), []
        self.score, self.gap, self.count, self.ids = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _segment(self, names: list[str]):
        """Score, gap, count and ids of chunks; slices of like lengths bound the memory."""
        order = sorted(range(len(names)), key=lambda k: len(names[k]))
        score, gap, count = np.empty(len(names)), np.empty(len(names)), np.empty(len(names), np.int64)
        parts, ids = [order[a : a + self.SLICE] for a in range(0, len(order), self.SLICE)], []
        for part in parts:
            done = Segmented([names[k] for k in part], self.pieces)
            score[part], gap[part], count[part] = done.score, done.gap, done.count
            ids.append(done.ids.astype(np.int32))
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for part, got in zip(parts, ids, strict=True):
            c = count[part]
            out[np.repeat(begin[part] - (np.cumsum(c) - c), c) + np.arange(c.sum())] = got
        return score, gap, count, out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, float, list[float]]]:
        """For each text: ids of the best segmentation, its score, and the scores of the `best` best ones."""
        where, number, had = [], self.index.__getitem__, len(self.index)
        for t in texts:
            got = self.pieces.chunks(t)
            where.append(np.fromiter(map(number, got), np.int64, len(got)))
        new = list(self.index)[had:]
        score, gap, count, ids = (np.concatenate(x) for x in zip((self.score, self.gap, self.count, self.ids), self._segment(new), strict=True))
        begin, names = np.cumsum(count) - count, self.names + new
        out = []
        for w in where:
            c = count[w]
            at = np.repeat(begin[w] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            total = float(score[w].sum())
            out.append((ids[at], total, self._best_of(w, gap[w], names, total)))
        if len(names) <= self.KEPT:
            self.score, self.gap, self.count, self.ids, self.names = score, gap, count, ids, names
        else:
            for name in new:
                del self.index[name]
        return out

    def _best_of(self, w, gap, names, score) -> list[float]:
        """A text's n best differ from its best in the n - 1 chunks with the least gaps at most; those are searched."""
        want = self.best - 1
        pick = np.argpartition(gap, want - 1)[:want] if 0 < want < len(gap) else np.arange(len(gap)) if want else []
        less = [0.0]
        for k in pick:
            if gap[k] < np.inf:
                name = names[w[k]]
                if name not in self.seen:
                    if len(self.seen) > 50_000:
                        self.seen.clear()
                    got = nbest(name, self.best, self.pieces)
                    self.seen[name] = [g[0] - got[0][0] for g in got]
                less = heapq.nlargest(self.best, (a + b for a in less for b in self.seen[name]))
        return [score + x for x in less]


def encode(docs: DataFrame, model_path: str, best: int = 4) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids, score, nbest (scores of the best `best` segmentations), decoded.

    Whole texts are segmented; decoded is the text that the ids give back. The vocabulary file is read on the driver only.
    Defined results: null and empty texts are the piece of one space and decode to empty; of equal scores the one with the longer last pieces wins;
    repeated rows give equal rows; an empty table gives no rows; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def run(batches):
        encoder = Encoder(held.value, best)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                texts = [t or "" for t in b.column(1).slice(a, 500).to_pylist()]
                got = encoder.encode(texts)
                decoded = [encoder.pieces.decode(g[0].tolist()) for g in got]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 500), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got]), pa.array([g[2] for g in got], pa.list_(pa.float64())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "score", "nbest", "decoded"])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.mapInArrow(run, "doc_id long, ids array<int>, score double, nbest array<double>, decoded string")


def digests(texts: list[str], encoder: Encoder) -> list[pa.Array]:
    """Columns of digest() for texts; copies, which a mix has side by side, are encoded once."""
    at = _Index()
    rows = pa.array([at[t] for t in texts], pa.int64())
    own = list(at)
    got = encoder.encode(own)
    ok = [encoder.pieces.decode(g[0].tolist()) == t for g, t in zip(got, own, strict=True)]
    made = [pa.array([len(t) for t in own], pa.int64()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([hashlib.md5(g[0].astype("<i4").tobytes()).hexdigest() for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.float64())), pa.array(ok, pa.bool_())]
    return [x.take(rows) for x in made]


def digest(docs: DataFrame, model_path: str, best: int = 4) -> DataFrame:
    """As encode(), with digests for what is long: doc_id, n_chars, n_pieces, ids_md5 (of little-endian 32-bit ids), score,
    nbest, decoded_ok (does decoding give the text back?). Digests are made where the ids are, so these stay there."""
    held = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def run(batches):
        encoder = Encoder(held.value, best)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                made = digests([t or "" for t in b.column(1).slice(a, 500).to_pylist()], encoder)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 500), *made], names=["doc_id", "n_chars", "n_pieces", "ids_md5", "score", "nbest", "decoded_ok"])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.mapInArrow(run, "doc_id long, n_chars long, n_pieces long, ids_md5 string, score double, nbest array<double>, decoded_ok boolean")
