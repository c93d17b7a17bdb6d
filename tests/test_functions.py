import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import ans, bits
from quillon.functions.codecs import BLOCK_CODECS, BitReader, BitWriter, vbyte64_decode, vbyte64_encode
from quillon.functions.partition import FIXED, indexed_bits, optimal_partition
from quillon.functions.text import porter

EDGES = [0, 1, 127, 128, 129, 2**14 - 1, 2**14, 2**21 - 1, 2**21, 2**28 - 2, 2**28 - 1, 2**28, 2**32 - 1]


@pytest.mark.parametrize("codec", sorted(BLOCK_CODECS))
@pytest.mark.parametrize("n", [1, 16, 127, 128, 256])
def test_block_round_trip(codec, n):
    encode, decode = BLOCK_CODECS[codec]
    rng = np.random.default_rng(n)
    for most in (1, 2, 300, 1 << 24):
        v = rng.integers(0, most, n).tolist()
        assert decode(encode(v), n) == v


@pytest.mark.parametrize("codec", sorted(BLOCK_CODECS))
def test_block_edges(codec):
    encode, decode = BLOCK_CODECS[codec]
    assert decode(encode(EDGES), len(EDGES)) == EDGES
    assert decode(encode([]), 0) == []


def test_integer_codes():
    w = BitWriter()
    for x in range(300):
        w.gamma(x), w.delta(x)
    r = BitReader(w.done())
    assert all((r.gamma(), r.delta()) == (x, x) for x in range(300))
    assert all(vbyte64_decode(vbyte64_encode(x)) == x for x in [*EDGES, 2**63])


def test_sizes_of_the_fixture(spark):
    want = [(1, 1, 4, 4, 1), (2, 1, 5, 5, 2), (1000, 10, 87, 87, 1004), (1000, 500, 1512, 1013, 1019), (1000, 1000, 2046, 1033, 1040), (100000, 3000, 21348, 21241, 102527)]
    u, n = F.col("u"), F.col("n")
    d = spark.createDataFrame([x[:2] for x in want], "u long, n long").select("u", "n", bits.elias_fano_bits(u, n), bits.strict_elias_fano_bits(u, n), bits.bitmap_bits(u, n))
    assert [tuple(r) for r in d.orderBy("u", "n").collect()] == want


def _counts(values, packed=False):
    x = np.asarray(values) + 1
    s = ans.magnitudes(x) if packed else ans.symbols(x)[0]
    return dict(zip(*(y.tolist() for y in np.unique(s, return_counts=True)), strict=True))


@pytest.mark.parametrize("packed", [False, True])
def test_ans_round_trip(packed):
    rng = np.random.default_rng(5)
    for most in (2, 3, 600, 70_000, 1 << 25):
        blocks = [rng.integers(0, most, n) for n in (1, 2, 10, 11, 100, 256, 256, 256)] + [np.zeros(20, np.int64)]
        flat = np.concatenate(blocks)
        model = ans.MagnitudeModel(_counts(flat, True), int(flat.max()) + 1) if packed else ans.ByteModel(_counts(flat))
        assert model.size & (model.size - 1) == 0 and model.size == (int((model.freq * ans.widths(int(flat.max()) + 1)).sum()) if packed else int(model.freq.sum()))
        for documents in (True, False):
            for wide in (True, False):
                ids, sizes = [int(b.any()) for b in blocks], [len(b) for b in blocks]
                data = ans.encode_blocks(blocks, ids, {1: model}, documents, wide)
                back = ans.decode_blocks(data, sizes, {1: model}, documents, wide, [int(b.sum()) for b in blocks])
                assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
                assert not documents or packed or data[0] == b"" == data[-1]
    x = np.array([1, 2, 256, 257, 2**16, 2**16 + 1, 2**24, 2**24 + 1, 2**32 - 1])
    s, k = ans.symbols(x)
    assert s.tolist() == [1, 2, 256, 257, 512, 513, 768, 769, 1023] and np.array_equal(ans.exception_sizes(s), k)


def test_ans_block_by_hand():
    """Two symbols of 16 slots each in a frame of 32: each value doubles the state, which starts at 0, and adds its own half."""
    model = ans.ByteModel({1: 50, 2: 50})
    assert model.size == 32 and model.freq[1:3].sum() + model.freq[0] == 32 and model.freq[1] == model.freq[2]
    f = int(model.freq[1])
    state = 0
    for v in (1, 0, 1):  # from the last to the first
        state = state // f * 32 + state % f + int(model.base[v + 1])
    data = ans.encode_blocks([np.array([1, 0, 1])], [1], {1: model}, False, False)[0]
    size = (state.bit_length() + 7) // 8
    assert data == bytes([1 << 4 | size, 0]) + state.to_bytes(size, "little")
    assert ans.encode_blocks([np.array([0, 0])], [0], {1: model}, False, False) == [b"\0"]


def test_ans_sizes_are_near_the_entropy():
    rng = np.random.default_rng(6)
    v = rng.geometric(0.3, 256 * 40) - 1
    c = np.unique(v, return_counts=True)[1]
    bits = float((c * np.log2(c.sum() / c)).sum())
    for model in (ans.ByteModel(_counts(v)), ans.MagnitudeModel(_counts(v, True), int(v.max()) + 1)):
        coded = sum(map(len, ans.encode_blocks(v.reshape(40, 256), [1] * 40, {1: model}, False, False)))
        assert bits / 8 < coded < 1.25 * bits / 8 + 40 * 8


def test_merging_and_magnitudes():
    rng = np.random.default_rng(1)
    counts = {m: {int(s): int(c) for s, c in zip(rng.integers(1, 1025, 20), rng.integers(1, 99, 20), strict=True)} for m in range(80)}
    to = ans.merged(counts, 10)
    assert to[0] == 0 and set(to.values()) == set(range(11))
    for counts, most in (({0: 100, 1: 50, 3: 20, 5: 1}, 30), ({0: 10**9, 1: 5, 20: 1}, 1 << 20), ({3: 7}, 6)):
        f = ans.magnitude_frequencies(counts, most)
        total = int((f * ans.widths(most)).sum())
        assert total & (total - 1) == 0 and all(f[m] > 0 for m in counts)
    assert ans.widths(30)[:7].tolist() == [1, 1, 2, 4, 8, 14, 0]


def test_frames_of_few_wide_values():
    """Few wide values, or rare small ones among many, would ask for frames past 2^32, in which the coder's state overflows."""
    rng = np.random.default_rng(8)
    for wide, small in ((4_130_000_000, 400), (1 << 28, 5000), ((1 << 32) - 2, 3)):
        blocks = [np.append(wide - k, rng.integers(small // 2, small, 255)) for k in range(8)] + [wide >> np.arange(6), np.array([1])]
        flat = np.concatenate(blocks)
        counts = _counts(flat, True)
        counts[max(m for m in counts if m < 20)] += 10**6 * (wide < 1 << 30)
        model = ans.MagnitudeModel(counts, int(flat.max()) + 1)
        assert model.size & (model.size - 1) == 0 and model.size <= 1 << 32 and all(model.freq[m] > 0 for m in counts)
        data = ans.encode_blocks(blocks, [15] * len(blocks), {15: model}, True, False)
        back = ans.decode_blocks(data, [len(b) for b in blocks], {15: model}, True, False)
        assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))


def test_partitions():
    rng = np.random.default_rng(0)
    v = np.unique(np.concatenate([rng.integers(0, 100_000, 300), np.arange(5000, 7000)])).tolist()
    ends = optimal_partition(v, 100_001)
    assert ends[-1] == len(v) and ends == sorted(set(ends)) and len(ends) > 1
    cost = sum(indexed_bits(v[z - 1] - (v[0] if a == 0 else v[a - 1] + 1) + 1, z - a) + FIXED for a, z in zip([0, *ends], ends, strict=False))
    assert cost <= indexed_bits(100_001, len(v)) + FIXED
    assert optimal_partition([0], 1) == [1]


@pytest.mark.parametrize("word,stem", [x.split() for x in "caresses caress,ponies poni,cats cat,agreed agre,plastered plaster,motoring motor,conflated conflat,hopping hop,falling fall,filing file,happy happi,sky sky,relational relat,conditional condit,rational ration,digitizer digit,hopefulness hope,triplicate triplic,formative form,revival reviv,adoption adopt,probate probat,rate rate,controll control,roll roll,is is".split(",")])
def test_porter(word, stem):
    assert porter(word) == stem
