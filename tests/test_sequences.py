"""Sequences in bits: every way to read them, at all densities, and their sizes against the closed formulas."""

import numpy as np
import pytest

from quillon.functions import sequences as sq
from quillon.functions.codecs import BLOCK_CODECS

KINDS = {
    "ef": sq.ELIAS_FANO, "strict_ef": sq.STRICT_ELIAS_FANO, "indexed": sq.INDEXED, "strict": sq.STRICT, "uniform": sq._Partitioned(sq.INDEXED, 128), "uniform strict": sq._Partitioned(sq.STRICT, 128),
    "opt": sq._Partitioned(sq.INDEXED, 0), "opt strict": sq._Partitioned(sq.STRICT, 0), "bitmap": sq._Plain(sq.Bitmap),
}


def made(n, universe, seed=42):
    return np.sort(np.random.default_rng(seed).choice(universe, n, replace=False))


def check(kind, v, universe):
    bits = np.concatenate([np.ones(3, np.uint8), kind.write(v, universe), np.ones(5, np.uint8)])
    r, n = kind.read(bits, 3, universe, len(v)), len(v)
    assert np.array_equal(r.decode(), v)
    rng = np.random.default_rng(1)
    for i in {0, n - 1, n // 2, *rng.integers(0, n, 30).tolist(), *(1 << k for k in range(12) if 1 << k < n)}:
        assert r.move(i) == (i, v[i]) and r.prev_value(i) == (v[i - 1] if i else 0)
    assert r.move(n) == (n, universe)
    for x in [0, v[0], v[-1], v[-1] + 1, universe, universe + 7, *rng.integers(0, universe, 40).tolist(), *(v[rng.integers(0, n, 20)] + 1).tolist()]:
        i = int(np.searchsorted(v, x))
        assert r.next_geq(int(x)) == ((i, v[i]) if i < n else (n, universe))


@pytest.mark.parametrize("name", KINDS)
@pytest.mark.parametrize("gap", [1.1, 1.9, 2.5, 3, 5, 10, 1024])
def test_reading(name, gap):
    check(KINDS[name], made(3000, int(3000 * gap)), int(3000 * gap))


@pytest.mark.parametrize("name", KINDS)
def test_short_and_full(name):
    for n in (1, 2, 42, 127, 128, 129, 300):
        first = int(np.random.default_rng(n).integers(0, 50_000))
        check(KINDS[name], first + made(n, 50_000 - 1), 100_000)
        check(KINDS[name], np.arange(n), n)
    check(KINDS[name], np.array([0]), 1)
    check(KINDS[name], np.array([1]), 2)
    for bad in ([], [5, 3], [3, 9]):
        with pytest.raises(ValueError):
            KINDS[name].write(np.array(bad, np.int64), 9)
    check(KINDS[name], np.concatenate([np.arange(500), 10_000 + made(200, 90_000), 120_000 + np.arange(700)]), 130_000)


def test_elias_fano_of_equal_values():
    v = np.sort(np.random.default_rng(0).integers(0, 900, 3000))
    assert np.array_equal(sq.ELIAS_FANO.read(sq.ELIAS_FANO.write(v, 900), 0, 900, 3000).decode(), v)


def test_sizes_are_those_of_the_formulas():
    for u, n, ef, strict, bitmap in [(1, 1, 4, 4, 1), (2, 1, 5, 5, 2), (1000, 10, 87, 87, 1004), (1000, 500, 1512, 1013, 1019), (1000, 1000, 2046, 1033, 1040), (100_000, 3000, 21_348, 21_241, 102_527)]:
        v = made(n, u)
        assert (len(sq.EliasFano.write(v, u)), len(sq.StrictEliasFano.write(v, u)), len(sq.Bitmap.write(v, u))) == (ef, strict, bitmap)
        for c in (sq.INDEXED, sq.STRICT):
            assert len(c.write(v, u)) == c.bits(u, n)
    v = np.concatenate([made(4000, 500_000), 600_000 + np.arange(5000)])
    assert len(KINDS["opt"].write(v, 700_000)) < len(KINDS["uniform"].write(v, 700_000)) < len(sq.INDEXED.write(v, 700_000))


@pytest.mark.parametrize("kind", sq.INDEX_TYPES)
def test_lists(kind):
    rng = np.random.default_rng(3)
    for n in (1, 2, 100, 2000):
        docs, freqs = made(n, 20_000), rng.integers(1, 257, n)
        if n == 2:
            freqs[:] = 1
        d, f = sq.write_list(kind, docs, freqs, 20_000)
        a, b = sq.read_list(kind, sq.unpack(sq.pack(d)), sq.unpack(sq.pack(f)), 20_000)
        assert np.array_equal(a.decode(), docs) and np.array_equal(b.decode(), freqs)
        assert a.next_geq(int(docs[-1]) + 1) == (n, 20_000) and b.move(n // 2) == (n // 2, freqs[n // 2]) and a.move(n - 1) == (n - 1, docs[-1])
    with pytest.raises(ValueError):
        sq.write_list(kind, [], [], 5)


def test_collections():
    rng = np.random.default_rng(4)
    some = [made(int(10_000 / g), 10_000, int(10 * g)) for g in np.arange(1.1, 11, 0.9)] + [np.array([0]), np.array([7])]
    for base in (sq.INDEXED, KINDS["uniform"], KINDS["opt"]):
        c = sq.Sequences(some, base)
        assert len(c) == len(some) and all(np.array_equal(c.get(k).decode(), v) for k, v in enumerate(some))
    with pytest.raises(ValueError):
        sq.Sequences([[]])
    vectors = [rng.integers(0, 2, n).astype(np.uint8) for n in (3, 0, 100, 1)]
    b = sq.BitVectors(vectors)
    assert all(np.array_equal(b.get(k), v) for k, v in enumerate(vectors)) and sq.BitVectors([]).size == 0


def test_positive():
    v = np.random.default_rng(5).integers(1, 257, 5000)
    for base in (sq.STRICT, KINDS["uniform strict"], KINDS["opt strict"]):
        c = sq.Positive(base)
        r = c.read(c.write(v, int(v.sum()) + 1), 0, int(v.sum()) + 1, len(v))
        assert np.array_equal(r.decode(), v) and r.move(77) == (77, v[77]) and r.move(5000)[0] == 5000
    with pytest.raises(ValueError):
        sq.Positive().write([1, 0], 2)


@pytest.mark.parametrize("name", ["optpfor", "varint", "interpolative"])
def test_short_blocks_and_known_sums(name):
    encode, decode = BLOCK_CODECS[name]
    rng = np.random.default_rng(6)
    for n in (1, 16, 127, 128):
        v = rng.integers(0, 1 << 20, n).tolist()
        for total in (None, sum(v)):
            assert decode(encode(v, total), n, total) == v
    assert BLOCK_CODECS["interpolative"][0]([9], 9) == b""
    short = BLOCK_CODECS["vbyte"][0]([5, 300])
    assert name == "interpolative" or encode([5, 300], None) == short
