"""Asymmetric numeral systems: models from symbol counts, and coding of many blocks side by side.

Two families share one coder. A model over leading bytes ("msb") has a symbol for each value up to 256 and for each leading byte
of larger ones, whose other bytes follow as exceptions. A model over magnitudes ("packed") gives all values of a magnitude one
frequency. A block is: header (model, bytes of the last state, number of words), state, words, exceptions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np

from .codecs import vbyte64_encode, vbyte_decode, vbyte_encode

#: Frame size for each distinct symbol, short blocks, models after merging, lower bounds of the coder's state, the most that the commonest magnitude weighs before a frame is rounded up, frames from which packed tables go by magnitude.
FRAME, SHORT, MODELS, LOWER, LOWER_PACKED, TOP, BY_MAGNITUDE = 16, 10, 63, 1 << 31, 1 << 24, 1 << 20, 1 << 16
#: The largest frame: the state stays under 2^32 times it, so under 2^64.
LARGEST = 1 << 32


def symbols(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of values above 0, and how many bytes each leaves to the exceptions."""
    k = (x > 1 << 8).astype(np.int64) + (x > 1 << 16) + (x > 1 << 24)
    return (x >> 8 * k) + 256 * k, k


def exception_sizes(symbol: np.ndarray) -> np.ndarray:
    return np.where(symbol <= 256, 0, np.minimum(3, (symbol - 257) // 256 + 1))


def magnitudes(x: np.ndarray) -> np.ndarray:
    """0 for 1, else the logarithm rounded up."""
    return np.ceil(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64)  # exact for 32-bit values


def least_of(mag: np.ndarray) -> np.ndarray:
    """The smallest value of a magnitude."""
    return np.where(mag == 0, 1, (1 << np.maximum(mag - 1, 0)) + 1)


def widths(most: int) -> np.ndarray:
    """How many values up to `most` each magnitude from 0 to 32 has."""
    mag = np.arange(33)
    return np.maximum(0, np.minimum(1 << mag, most) - least_of(mag) + 1)


def _power(x: int) -> int:
    """The least power of two that is no less."""
    return 1 << max(0, int(x) - 1).bit_length()


def _spread(f: np.ndarray, width: np.ndarray, excess: int) -> int:
    """Share excess out over frequencies in proportion, from the last to the first, in place; gives back what does not divide."""
    total = int((f * width).sum())
    for s in np.flatnonzero(f)[::-1].tolist():
        before = int(f[s])
        more = min(int(excess / total * before), excess // int(width[s]))
        f[s] += more
        excess -= more * int(width[s])
        total -= before * int(width[s])
    return excess


def normalized(counts: dict[int, int]) -> np.ndarray:
    """Frequencies of symbols 0 to 1024 that add up to the power of two of at least FRAME for each symbol.

    Counts are scaled to the frame and shrunk by hundredths, none under 1, until they fit; what is left over is shared out from
    the last symbol on, and the rest of it is the frequency of symbol 0, which no value has."""
    c = np.zeros(1025, np.int64)
    c[list(counts)] = list(counts.values())
    size = _power(FRAME * int((c > 0).sum()))
    shrink, f = np.float32(1), None
    while f is None or f.sum() > size:
        shrink = np.float32(np.float64(shrink) - 0.01)
        f = np.where(c > 0, np.maximum(1, ((shrink * c.astype(np.float32)).astype(np.float64) * (size / c.sum())).astype(np.int64)), 0)
    f[0] += _spread(f, np.ones(1025, np.int64), size - int(f.sum()))
    return f


def magnitude_frequencies(counts: dict[int, int], most: int) -> np.ndarray:
    """A frequency for each value of a magnitude, so that all values up to `most` add up to a power of two.

    The largest magnitude weighs half of its values, the others in proportion, none under 1; the smallest is held to TOP. What
    is missing to the next power of two is shared out from the largest magnitude on, and what does not divide goes to value 1.
    Where that would be over LARGEST, all are halved, none under 1, until it is not: at 1 each they add up to `most` or less."""
    width, c = widths(most), np.zeros(33, np.int64)
    for m, n in counts.items():
        c[m] = n if width[m] else 0
    some = np.flatnonzero(c)
    first, last = some[0], some[-1]
    scale = 0.5 * width[last] / c[last]
    f = np.where(c > 0, np.maximum(1, (0.5 + c * scale / np.maximum(width, 1)).astype(np.int64)), 0)
    if f[first] > TOP:
        rest = np.arange(33) > first
        f[rest] = np.where(c[rest] > 0, np.maximum(1, (0.5 + f[rest] * (TOP / f[first])).astype(np.int64)), 0)
        f[first] = TOP
    while (f * width).sum() > LARGEST:
        f = np.where(f > 0, np.maximum(1, f // 2), 0)
    excess = _spread(f, np.maximum(width, 1), _power((f * width).sum()) - int((f * width).sum()))
    f[first] += excess // width[first]
    f[0] += excess % width[first]
    return f


class ByteModel:
    """A model over leading bytes: frequency and base of each symbol, and the symbol of each slot of the frame."""

    packed = False

    def __init__(self, counts: dict[int, int]):
        self.freq = normalized(counts)
        self.size, self.lower = int(self.freq.sum()), LOWER
        self.base = np.cumsum(self.freq) - self.freq
        self.fast = self.size <= 255 and max(counts) <= 255
        self.slots = np.repeat(np.arange(1025), self.freq).astype(np.uint8 if self.fast else np.uint16)

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frequency and base of each value (from 0)."""
        s, _ = symbols(values + 1)
        return self.freq[s], self.base[s]

    def at(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What lies at slots of the frame: symbol, frequency, base."""
        s = self.slots[slot].astype(np.int64)
        return s, self.freq[s], self.base[s]


class MagnitudeModel:
    """A model over magnitudes. Frames under BY_MAGNITUDE have a table of all slots; larger ones are searched by magnitude."""

    packed = True

    def __init__(self, counts: dict[int, int], most: int):
        self.freq, width = magnitude_frequencies(counts, most), widths(most)
        whole = self.freq * width
        self.size = int(whole.sum())
        self.lower = max(LOWER_PACKED, self.size)
        self.base = np.cumsum(whole) - whole
        self.some = np.flatnonzero(whole)
        self.by_magnitude = self.size >= BY_MAGNITUDE
        if not self.by_magnitude:
            self.slots = np.concatenate([np.repeat(least_of(m) + np.arange(width[m]), self.freq[m]) for m in self.some])

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = magnitudes(values + 1)
        return self.freq[m], self.base[m] + self.freq[m] * (values + 1 - least_of(m))

    def at(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.by_magnitude:
            x = self.slots[slot]
            return x, *self.places(x - 1)
        m = self.some[np.searchsorted(self.base[self.some], slot, side="right") - 1]
        x = least_of(m) + (slot - self.base[m]) // self.freq[m]
        return x, *self.places(x - 1)


@dataclass
class Coded:
    """A block's last state and its words, in the order in which decoding wants them."""

    state: int
    words: np.ndarray


def push(blocks: Sequence[np.ndarray], model) -> list[Coded]:
    """Code the values of blocks of one model side by side, each from its last value to its first."""
    size = np.array([len(b) for b in blocks])
    steps, n = int(size.max(initial=0)), len(blocks)
    f, b = np.ones((steps, n), np.uint64), np.zeros((steps, n), np.uint64)
    for k, x in enumerate(blocks):
        freq, base = model.places(np.asarray(x, np.int64))
        f[: len(x), k], b[: len(x), k] = freq, base
    m = np.uint64(model.size)
    lower = np.uint64(model.lower // model.size)
    state, words, count = np.zeros(n, np.uint64), np.zeros((steps + 1, n), np.uint32), np.zeros(n, np.int64)
    for t in range(steps - 1, -1, -1):
        on = np.flatnonzero(size > t)
        s, ft = state[on], f[t, on]
        full = s >= (lower * ft) << np.uint64(32)
        out = on[full]
        words[count[out], out] = (s[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        count[out] += 1
        s = np.where(full, s >> np.uint64(32), s)
        state[on] = s // ft * m + s % ft + b[t, on]
    return [Coded(int(state[k]), words[: count[k], k][::-1]) for k in range(n)]


def pop(coded: Sequence[Coded], sizes: Sequence[int], model) -> list[np.ndarray]:
    """The symbols of blocks coded by push()."""
    size, n = np.asarray(sizes), len(coded)
    steps = int(size.max(initial=0))
    out, state = np.zeros((steps, n), np.int64), np.array([c.state for c in coded], np.uint64)
    words, left = np.zeros((max((len(c.words) for c in coded), default=0) + 1, n), np.uint64), np.array([len(c.words) for c in coded])
    for k, c in enumerate(coded):
        words[: len(c.words), k] = c.words
    at, lower = np.zeros(n, np.int64), np.uint64(model.lower)
    shift, mask = np.uint64(model.size.bit_length() - 1), np.uint64(model.size - 1)
    for t in range(steps):
        on = np.flatnonzero(size > t)
        s = state[on]
        slot = (s & mask).astype(np.int64)
        x, f, b = model.at(slot)
        s = f.astype(np.uint64) * (s >> shift) + (slot - b).astype(np.uint64)
        low = (s < lower) & (at[on] < left[on])
        s[low] = s[low] << np.uint64(32) | words[at[on][low], on[low]]
        at[on[low]] += 1
        out[t, on], state[on] = x, s
    return [out[: size[k], k] for k in range(n)]


def _header(model: int, state: bytes, words: int, wide: bool) -> bytes:
    """A byte of model and state bytes, or one for each where there are more than 16 models; then the words, at full width."""
    head = bytes([model, len(state)]) if wide else bytes([model << 4 | len(state)])
    return head + vbyte64_encode(words)


def _exceptions(values: np.ndarray) -> bytes:
    s, k = symbols(values + 1)
    return b"".join(int(v & ((1 << 8 * w) - 1)).to_bytes(w, "little") for v, w in zip((values + 1).tolist(), k.tolist(), strict=True) if w)


def encode_blocks(blocks: Sequence[np.ndarray], ids: Sequence[int], models: dict, documents: bool, wide: bool) -> list[bytes]:
    """Blocks of values (from 0), each with the number of its model; model 0 is that of blocks of zeros.

    Leading-byte models: a block of zeros whose sum the reader knows (documents) and a document block of one value are nothing,
    other document blocks of up to SHORT values are seven-bit bytes. A block of model 0 is its header. Packed models have no
    such exceptions."""
    out: list[bytes] = [b""] * len(blocks)
    by: dict[int, list[int]] = {}
    packed = any(m.packed for m in models.values())
    for k, (x, m) in enumerate(zip(blocks, ids, strict=True)):
        if not packed and documents and (len(x) == 1 or not np.any(x)):
            continue
        if not packed and documents and len(x) <= SHORT:
            out[k] = vbyte_encode(np.asarray(x).tolist())
        elif m == 0:
            out[k] = bytes([0])
        else:
            by.setdefault(m, []).append(k)
    for m, at in by.items():
        for k, c in zip(at, push([blocks[k] for k in at], models[m]), strict=True):
            state = c.state.to_bytes((c.state.bit_length() + 7) // 8, "little")
            rest = b"" if packed else _exceptions(np.asarray(blocks[k], np.int64))
            out[k] = _header(m, state, len(c.words), wide) + state + c.words.astype("<u4").tobytes() + rest
    return out


def decode_blocks(data: Sequence[bytes], sizes: Sequence[int], models: dict, documents: bool, wide: bool, known: Sequence[int] | None = None) -> list[np.ndarray]:
    """What encode_blocks() coded. known: of document blocks the sum of their values, as the block table gives it."""
    out: list[np.ndarray] = [np.zeros(n, np.int64) for n in sizes]
    packed = any(m.packed for m in models.values())
    by: dict[int, list[tuple[int, Coded, int]]] = {}
    for k, (d, n) in enumerate(zip(data, sizes, strict=True)):
        if not packed and documents and (n <= SHORT or not d):
            if n == 1 and known is not None:
                out[k][0] = known[k]
            elif d:
                out[k] = np.array(vbyte_decode(d, n), np.int64)
            continue
        m, state = (d[0], d[1] if d[0] else 0) if wide else (d[0] >> 4, d[0] & 15)
        if m == 0:
            continue
        at, words, shift = 2 if wide else 1, 0, 0
        while True:
            words |= (d[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if d[at - 1] < 128:
                break
        w = at + state
        by.setdefault(m, []).append((k, Coded(int.from_bytes(d[at:w], "little"), np.frombuffer(d[w : w + 4 * words], "<u4")), w + 4 * words))
    for m, rows in by.items():
        for (k, _, at), got in zip(rows, pop([c for _, c, _ in rows], [sizes[k] for k, _, _ in rows], models[m]), strict=True):
            if packed:
                out[k] = got - 1
                continue
            e = exception_sizes(got)
            values = got - 256 * e
            for j in np.flatnonzero(e).tolist():
                values[j] = int(values[j]) << 8 * int(e[j]) | int.from_bytes(data[k][at : at + int(e[j])], "little")
                at += int(e[j])
            out[k] = values - 1
    return out


def _entropy(counts: np.ndarray) -> float:
    c = counts[counts > 0]
    return float((c * np.log2(c.sum() / c)).sum()) if len(c) else 0.0


def merged(counts: dict[int, dict[int, int]], most: int = MODELS) -> dict[int, int]:
    """Model of each context after merging: pairs whose union costs the fewest bits are merged until `most` are left.

    Context 0 stays model 0; the others are numbered from 1. At most 256 contexts of 1,025 symbols come in."""
    ids = sorted(m for m in counts if m != 0 and counts[m])
    table = {m: np.zeros(1025) for m in ids}
    for m in ids:
        for s, c in counts[m].items():
            table[m][s] = c
    home = {m: m for m in ids}
    own = {m: _entropy(table[m]) for m in ids}
    loss = {(a, b): _entropy(table[a] + table[b]) - own[a] - own[b] for a, b in combinations(ids, 2)}
    while len(table) > most:
        a, b = min(loss, key=lambda p: (loss[p], p))
        table[a] = table[a] + table.pop(b)
        own[a] = _entropy(table[a])
        home = {m: a if h == b else h for m, h in home.items()}
        loss = {p: v for p, v in loss.items() if b not in p and a not in p}
        loss |= {(min(a, m), max(a, m)): _entropy(table[a] + table[m]) - own[a] - own[m] for m in table if m != a}
    number = {m: k + 1 for k, m in enumerate(sorted(table))}
    return {0: 0} | {m: number[home[m]] for m in ids}
