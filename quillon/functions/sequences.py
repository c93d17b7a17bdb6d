"""Monotone sequences as bits, read in place: plain and strict Elias-Fano, ranked bitmaps, the cheapest of them, prefix sums, partitions.

write(values, universe) gives the bits; read(bits, at, universe, n) a reader of n values that begin at bit `at`. A reader has
move(i), next_geq(x), prev_value(i) and decode(); past its end it gives (n, universe). Bits are numpy arrays of 0 and 1;
pack() makes bytes of them."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

from .bits import EF0, EF1, PICK, RANK
from .partition import optimal_partition

#: Sampling that means no samples, and the size of uniform partitions.
NEVER, PART = 63, 128


def ceil_log2(x: int) -> int:
    return (x - 1).bit_length() if x > 1 else 0


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")


def fixed(values, width: int) -> np.ndarray:
    """Numbers of `width` bits side by side."""
    v = np.asarray(values, np.int64).reshape(-1, 1)
    return ((v >> np.arange(width)) & 1).astype(np.uint8).ravel()


def number(bits: np.ndarray, at: int, width: int) -> int:
    return int.from_bytes(pack(bits[at : at + width]), "little")


def gamma(x: int) -> np.ndarray:
    low = (x + 1).bit_length() - 1
    return np.concatenate([fixed([1 << low], low + 1), fixed([x + 1 - (1 << low)], low)])


def delta(x: int) -> np.ndarray:
    low = (x + 1).bit_length() - 1
    return np.concatenate([gamma(low), fixed([x + 1 - (1 << low)], low)])


def read_gamma(bits: np.ndarray, at: int) -> tuple[int, int]:
    """The number, and where it ends."""
    low = int(np.argmax(bits[at:]))
    return (1 << low) + number(bits, at + low + 1, low) - 1, at + 2 * low + 1


def read_delta(bits: np.ndarray, at: int) -> tuple[int, int]:
    low, at = read_gamma(bits, at)
    return (1 << low) + number(bits, at, low) - 1, at + low


class Reader:
    """n values under a universe. A kind of sequence has move() and may do better than search by it."""

    n: int
    universe: int

    def __len__(self) -> int:
        return self.n

    def move(self, i: int) -> tuple[int, int]:
        raise NotImplementedError

    def next_geq(self, x: int) -> tuple[int, int]:
        """(position, value) of the first value that is x or more."""
        return self.move(bisect_left(range(self.n), x, key=lambda i: self.move(i)[1]))

    def prev_value(self, i: int) -> int:
        """The value before position i; 0 at the start."""
        return self.move(i - 1)[1] if i else 0

    def decode(self) -> np.ndarray:
        return np.array([self.move(i)[1] for i in range(self.n)], np.int64)


def _sorted(values, universe: int, strictly: bool = False) -> np.ndarray:
    v = np.asarray(values, np.int64)
    if not len(v):
        raise ValueError("the sequence is empty")
    if (np.diff(v) < (1 if strictly else 0)).any():
        raise ValueError("the sequence is not sorted")
    if v[0] < 0 or v[-1] >= universe:
        raise ValueError("a value lies outside the universe")
    return v


class EliasFano(Reader):
    """Pointers to every 2^zeros-th zero and 2^ones-th one of the high bits, high bits in unary, low bits side by side."""

    def __init__(self, bits: np.ndarray, at: int, universe: int, n: int, zeros: int = EF0, ones: int = EF1):
        self.n, self.universe, self.zeros, self.ones = n, universe, zeros, ones
        self.low = (universe // n).bit_length() - 1 if universe > n else 0
        size = n + (universe >> self.low) + 2
        self.width = ceil_log2(size)
        self.to_zeros, self.to_ones = at, at + ((size - n) >> zeros) * self.width
        self.high = bits[self.to_ones + (n >> ones) * self.width :][:size]
        self.lows = self.to_ones + (n >> ones) * self.width + size
        self.bits, self.end = bits, self.lows + n * self.low

    @staticmethod
    def write(values, universe: int, zeros: int = EF0, ones: int = EF1) -> np.ndarray:
        v, n = _sorted(values, universe), len(values)
        low = (universe // n).bit_length() - 1 if universe > n else 0
        high = np.zeros(n + (universe >> low) + 2, np.uint8)
        high[(v >> low) + np.arange(n)] = 1
        width = ceil_log2(len(high))
        z, o = np.flatnonzero(high == 0), np.flatnonzero(high)
        pointers = [p[(np.arange(len(p) >> s) + 1 << s) - 1] if s < NEVER else p[:0] for p, s in ((z, zeros), (o, ones))]
        return np.concatenate([fixed(pointers[0], width), fixed(pointers[1], width), high, fixed(v & ((1 << low) - 1), low)])

    def _place(self, k: int, bit: int) -> int:
        """Where the k-th (from 0) zero or one of the high bits is: from the pointer before it, onwards in growing steps."""
        sampled, first = (self.ones, self.to_ones) if bit else (self.zeros, self.to_zeros)
        block = (k + 1) >> sampled
        at = number(self.bits, first + (block - 1) * self.width, self.width) if block else -1
        left = k + 1 - (block << sampled)  # how many more of them come after `at`
        step = 4 * left + 64
        while left:
            found = np.flatnonzero(self.high[at + 1 : at + 1 + step] == bit)
            if len(found) >= left:
                return at + 1 + int(found[left - 1])
            left, at, step = left - len(found), at + step, 2 * step
        return at

    def _value(self, i: int, place: int) -> int:
        return (place - i) << self.low | number(self.bits, self.lows + i * self.low, self.low)

    def move(self, i: int) -> tuple[int, int]:
        return (i, self._value(i, self._place(i, 1))) if i < self.n else (self.n, self.universe)

    def next_geq(self, x: int) -> tuple[int, int]:
        if x >= self.universe:
            return self.n, self.universe
        h = x >> self.low
        at = self._place(h - 1, 0) + 1 if h > 0 else 0  # values with the same high bits begin after the zero before them
        i = at - h
        while i < self.n:
            ones = np.flatnonzero(self.high[at : at + 512])
            for place in (at + ones).tolist():
                if i < self.n and (v := self._value(i, place)) >= x:
                    return i, v
                i += 1
            at += 512
        return self.n, self.universe

    def decode(self) -> np.ndarray:
        lows = self.bits[self.lows : self.end].reshape(self.n, self.low).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
        return (np.flatnonzero(self.high)[: self.n] - np.arange(self.n)) << self.low | lows


class StrictEliasFano(Reader):
    """Of values that grow: each less its position."""

    def __init__(self, bits, at, universe, n, zeros: int = EF0):
        self.n, self.universe = n, universe
        self.inner = EliasFano(bits, at, universe - n + 1, n, zeros)
        self.end = self.inner.end

    @staticmethod
    def write(values, universe: int, zeros: int = EF0) -> np.ndarray:
        v = _sorted(values, universe, True)
        return EliasFano.write(v - np.arange(len(v)), universe - len(v) + 1, zeros)

    def move(self, i):
        return (i, self.inner.move(i)[1] + i) if i < self.n else (self.n, self.universe)

    def decode(self):
        return self.inner.decode() + np.arange(self.n)


class Bitmap(Reader):
    """Ranks before every 2^ranks-th place, places of every 2^picks-th one, and a bit for each value of the universe."""

    def __init__(self, bits, at, universe, n, ranks: int = RANK, picks: int = PICK):
        self.n, self.universe, self.ranks, self.picks, self.bits = n, universe, ranks, picks, bits
        self.rank_width, self.width = ceil_log2(n + 1), ceil_log2(universe)
        self.to_ranks = at
        self.to_ones = at + (universe >> ranks) * self.rank_width
        self.begin = self.to_ones + (n >> picks) * self.width
        self.end = self.begin + universe
        self.map = bits[self.begin : self.end]

    @staticmethod
    def write(values, universe: int, ranks: int = RANK, picks: int = PICK) -> np.ndarray:
        v, n = _sorted(values, universe, True), len(values)
        places = np.zeros(universe, np.uint8)
        places[v] = 1
        before = np.searchsorted(v, np.arange(1, (universe >> ranks) + 1) << ranks) if ranks < NEVER else v[:0]
        return np.concatenate([fixed(before, ceil_log2(n + 1)), fixed(v[(np.arange(n >> picks) + 1 << picks) - 1], ceil_log2(universe)), places])

    def move(self, i):
        if i >= self.n:
            return self.n, self.universe
        block = (i + 1) >> self.picks
        at = number(self.bits, self.to_ones + (block - 1) * self.width, self.width) if block else -1
        left, step = i + 1 - (block << self.picks), 512
        while left:
            found = np.flatnonzero(self.map[at + 1 : at + 1 + step])
            if len(found) >= left:
                return i, at + 1 + int(found[left - 1])
            left, at, step = left - len(found), at + step, 2 * step
        return i, at

    def next_geq(self, x):
        if x >= self.universe:
            return self.n, self.universe
        block = x >> self.ranks
        i = number(self.bits, self.to_ranks + (block - 1) * self.rank_width, self.rank_width) if block else 0
        i += int(self.map[block << self.ranks : x].sum(dtype=np.int64))
        at, step = x, 512
        while at < self.universe:
            found = self.map[at : at + step]
            if found.any():
                return i, at + int(np.argmax(found))
            at, step = at + step, 2 * step
        return self.n, self.universe

    def decode(self):
        return np.flatnonzero(self.map).astype(np.int64)


class AllOnes(Reader):
    """Every value of the universe; no bits."""

    def __init__(self, bits, at, universe, n):
        self.n, self.universe, self.end = n, universe, at

    def move(self, i):
        return (i, i) if i < self.n else (self.n, self.universe)

    def next_geq(self, x):
        return self.move(x)

    def decode(self):
        return np.arange(self.n, dtype=np.int64)


class _Cheapest:
    """The cheapest of all ones, Elias-Fano and bitmap by their size; one bit says which of the last two. Ties go to the earlier."""

    def __init__(self, coder, zeros: int, ranks: int):
        self.coder, self.zeros, self.ranks = coder, zeros, ranks

    def sizes(self, universe: int, n: int) -> tuple[int, int]:
        u = universe - n + 1 if self.coder is StrictEliasFano else universe
        low = (u // n).bit_length() - 1 if u > n else 0
        high = n + (u >> low) + 2
        ef = ((high - n) >> self.zeros) * ceil_log2(high) + (n >> EF1) * ceil_log2(high) + high + n * low
        return ef, (universe >> self.ranks) * ceil_log2(n + 1) + (n >> PICK) * ceil_log2(universe) + universe

    def bits(self, universe: int, n: int) -> int:
        return 0 if universe == n else min(self.sizes(universe, n)) + 1

    def write(self, values, universe: int) -> np.ndarray:
        n = len(_sorted(values, universe, universe == len(values)))
        if universe == n:
            return np.zeros(0, np.uint8)
        ef, bitmap = self.sizes(universe, n)
        body = self.coder.write(values, universe, self.zeros) if ef <= bitmap else Bitmap.write(values, universe, self.ranks)
        return np.concatenate([np.array([ef > bitmap], np.uint8), body])

    def read(self, bits, at, universe, n) -> Reader:
        if universe == n:
            return AllOnes(bits, at, universe, n)
        return Bitmap(bits, at + 1, universe, n, self.ranks) if bits[at] else self.coder(bits, at + 1, universe, n, self.zeros)


class _Plain:
    """Elias-Fano alone, plain or strict."""

    def __init__(self, coder):
        self.coder = coder

    def write(self, values, universe):
        return self.coder.write(values, universe)

    def read(self, bits, at, universe, n):
        return self.coder(bits, at, universe, n)


class _Parts(Reader):
    """A list in partitions, each from its own base with its own universe."""

    def __init__(self, kind, bits, at, universe, n):
        self.kind, self.n, self.universe, self.bits = kind, n, universe, bits
        parts, at = read_gamma(bits, at)
        self.parts = parts + 1
        if self.parts == 1:
            width = ceil_log2(universe)
            base, at, tail = number(bits, at, width), at + width, 0
            if n > 1:
                tail, at = read_delta(bits, at)
                tail = tail or universe - 1 - base
            self.starts, self.bounds, self.ends, self.begin = np.array([0, n]), np.array([base, base + tail]), [0], at
            return
        width, at = read_gamma(bits, at)
        if kind.size:
            inner = np.arange(1, self.parts) * kind.size
        else:
            sizes = EliasFano(bits, at, n, self.parts - 1)
            inner, at = sizes.decode(), sizes.end
        uppers = EliasFano(bits, at, universe, self.parts + 1)
        self.starts, self.bounds = np.concatenate([[0], inner, [n]]), uppers.decode()
        self.ends = [0] + [number(bits, uppers.end + k * width, width) for k in range(self.parts - 1)]
        self.begin = uppers.end + (self.parts - 1) * width

    def part(self, p: int) -> tuple[Reader, int]:
        """Reader and base of a partition."""
        base = int(self.bounds[p]) + (p > 0)
        return self.kind.base.read(self.bits, self.begin + self.ends[p], int(self.bounds[p + 1]) - base + 1, int(self.starts[p + 1] - self.starts[p])), base

    def move(self, i):
        if i >= self.n:
            return self.n, self.universe
        p = int(np.searchsorted(self.starts, i, side="right")) - 1
        reader, base = self.part(p)
        return i, base + reader.move(i - int(self.starts[p]))[1]

    def next_geq(self, x):
        p = int(np.searchsorted(self.bounds[1:], x))  # the first partition that ends at x or above
        if p == self.parts:
            return self.n, self.universe
        reader, base = self.part(p)
        i, v = reader.next_geq(max(0, x - base))
        return int(self.starts[p]) + i, base + v

    def decode(self):
        return np.concatenate([base + reader.decode() for reader, base in map(self.part, range(self.parts))])


class _Partitioned:
    """size: postings of a partition; 0 for near-optimal ends. base: how partitions are coded."""

    def __init__(self, base, size: int):
        self.base, self.size = base, size

    def cuts(self, v: np.ndarray, universe: int) -> list[int]:
        if self.size:
            return [*range(self.size, len(v), self.size), len(v)]
        return optimal_partition(v.tolist(), universe, cost=self.base.bits)

    def write(self, values, universe: int) -> np.ndarray:
        v, n = _sorted(values, universe, True), len(values)
        ends = self.cuts(v, universe)
        starts = [0, *ends[:-1]]
        bases = [int(v[0]), *(int(v[a - 1]) + 1 for a in starts[1:])]
        bodies = [self.base.write(v[a:z] - b, int(v[z - 1]) - b + 1) for a, z, b in zip(starts, ends, bases, strict=True)]
        out = [gamma(len(ends) - 1)]
        if len(ends) == 1:
            out.append(fixed([v[0]], ceil_log2(universe)))
            if n > 1:
                out.append(delta(0 if v[-1] + 1 == universe else int(v[-1] - v[0])))
            return np.concatenate([*out, *bodies])
        at = np.cumsum([len(b) for b in bodies])
        width = ceil_log2(int(at[-1]) + 1)
        out.append(gamma(width))
        if not self.size:
            out.append(EliasFano.write(ends[:-1], n))
        out.append(EliasFano.write([v[0], *v[np.array(ends) - 1]], universe))
        return np.concatenate([*out, fixed(at[:-1], width), *bodies])

    def read(self, bits, at, universe, n) -> Reader:
        return _Parts(self, bits, at, universe, n)


ELIAS_FANO, STRICT_ELIAS_FANO = _Plain(EliasFano), _Plain(StrictEliasFano)
INDEXED, STRICT = _Cheapest(EliasFano, EF0, RANK), _Cheapest(StrictEliasFano, NEVER, NEVER)


class _Positive(Reader):
    """Positive numbers by their running sums."""

    def __init__(self, sums: Reader):
        self.sums, self.n, self.universe = sums, sums.n, sums.universe

    def move(self, i):
        return (i, self.sums.move(i)[1] - self.sums.prev_value(i)) if i < self.n else (self.n, self.universe)

    def decode(self):
        return np.diff(self.sums.decode(), prepend=0)


class Positive:
    """Coder of positive numbers; universe is their sum and one."""

    def __init__(self, base=STRICT):
        self.base = base

    def write(self, values, universe: int) -> np.ndarray:
        if (np.asarray(values) < 1).any():
            raise ValueError("a number is not positive")
        return self.base.write(np.cumsum(np.asarray(values, np.int64)), universe)

    def read(self, bits, at, universe, n) -> Reader:
        return _Positive(self.base.read(bits, at, universe, n))


#: Index types whose lists are sequences: how documents and how frequencies are coded.
INDEX_TYPES = {
    "ef": (ELIAS_FANO, Positive(STRICT_ELIAS_FANO)),
    "single": (INDEXED, Positive(STRICT)),
    "uniform": (_Partitioned(INDEXED, PART), Positive(_Partitioned(STRICT, PART))),
    "opt": (_Partitioned(INDEXED, 0), Positive(_Partitioned(STRICT, 0))),
}


def write_list(kind: str, docs, freqs, num_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of a list's documents, after a header of its occurrences and length, and of its frequencies. An empty list is an error."""
    if not len(docs):
        raise ValueError("the list is empty")
    of_docs, of_freqs = INDEX_TYPES[kind]
    total = int(np.sum(freqs))
    head = [gamma(total - 1)] + ([fixed([len(docs)], ceil_log2(total + 1))] if total > 1 else [])
    return np.concatenate([*head, of_docs.write(docs, num_docs)]), of_freqs.write(freqs, total + 1)


def read_list(kind: str, docs: np.ndarray, freqs: np.ndarray, num_docs: int) -> tuple[Reader, Reader]:
    of_docs, of_freqs = INDEX_TYPES[kind]
    total, at = read_gamma(docs, 0)
    n, total = 1, total + 1
    if total > 1:
        n, at = number(docs, at, ceil_log2(total + 1)), at + ceil_log2(total + 1)
    return of_docs.read(docs, at, num_docs, n), of_freqs.read(freqs, 0, total + 1, n)


class BitVectors:
    """Bit vectors end to end, and where they end as Elias-Fano; get(k) gives the k-th."""

    def __init__(self, vectors: list[np.ndarray]):
        self.size = len(vectors)
        ends = np.cumsum([0, *map(len, vectors)])
        self.total = int(ends[-1])
        self.bits = np.concatenate([np.zeros(0, np.uint8), *vectors])
        self.ends = EliasFano.write(ends, self.total + 1)

    def get(self, k: int) -> np.ndarray:
        reader = EliasFano(self.ends, 0, self.total + 1, self.size + 1)
        return self.bits[reader.move(k)[1] : reader.move(k + 1)[1]]


class Sequences:
    """Monotone sequences of one coder, each after a header of its last value's power of two and its length."""

    def __init__(self, sequences: list, base=INDEXED):
        self.base, made = base, []
        for v in sequences:
            if not len(v):
                raise ValueError("a sequence is empty")
            top = ceil_log2(int(v[-1]))
            made.append(np.concatenate([gamma(top), gamma(len(v) - 1), base.write(v, (1 << top) + 1)]))
        self.vectors = BitVectors(made)

    def __len__(self) -> int:
        return self.vectors.size

    def get(self, k: int) -> Reader:
        bits = self.vectors.get(k)
        top, at = read_gamma(bits, 0)
        n, at = read_gamma(bits, at)
        return self.base.read(bits, at, (1 << top) + 1, n + 1)
