"""Integer code lengths and encoding sizes in bits as column expressions; every argument is a BIGINT column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Selector of each magnitude 0 to 32.
MAG2SEL = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 13, 14, 14, 14, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15]
#: log2 of the pointer sampling of zeros and ones in Elias-Fano, and of ranks and ones in bitmaps.
EF0, EF1, RANK, PICK = 9, 8, 9, 8


def floor_log2(x: Column) -> Column:
    return F.length(F.bin(x)).cast("long") - 1


def ceil_log2(x: Column) -> Column:
    return F.when(x > 1, F.length(F.bin(x - 1))).otherwise(0).cast("long")


def gamma_bits(x: Column) -> Column:
    return 2 * floor_log2(x + 1) + 1


def delta_bits(x: Column) -> Column:
    return gamma_bits(floor_log2(x + 1)) + floor_log2(x + 1)


def vbyte_bytes(x: Column) -> Column:
    """Bytes of a 32-bit value at seven bits a byte."""
    return F.when(x < 1 << 7, 1).when(x < 1 << 14, 2).when(x < 1 << 21, 3).when(x < 1 << 28, 4).otherwise(5).cast("long")


def vbyte64_bytes(x: Column) -> Column:
    return F.when(x > 0, F.ceil((floor_log2(x) + 1) / 7)).otherwise(1).cast("long")


def elias_fano_bits(u: Column, n: Column, zeros: int = EF0, ones: int = EF1) -> Column:
    """Size of n values under u, with pointers to every 2^zeros-th zero and 2^ones-th one (63: none)."""
    low = F.when(u > n, floor_log2(F.floor(u / n))).otherwise(0)
    high = n + F.call_function("shiftright", u, low.cast("int")) + 2
    pointer = ceil_log2(high)
    skip = F.lit(0) if zeros >= 63 else F.shiftright(high - n, zeros) * pointer
    return (skip + F.shiftright(n, ones) * pointer + high + n * low).cast("long")


def strict_elias_fano_bits(u: Column, n: Column, zeros: int = EF0, ones: int = EF1) -> Column:
    return elias_fano_bits(u - n + 1, n, zeros, ones)


def bitmap_bits(u: Column, n: Column, ranks: int = RANK, picks: int = PICK) -> Column:
    skip = F.lit(0) if ranks >= 63 else F.shiftright(u, ranks) * ceil_log2(n + 1)
    return (skip + F.shiftright(n, picks) * ceil_log2(u) + u).cast("long")


def all_ones_bits(u: Column, n: Column) -> Column:
    """0 if every value under u is there, else null (not possible)."""
    return F.when(u == n, F.lit(0)).cast("long")


def cheapest(ones: Column, ef: Column, bitmap: Column) -> tuple[Column, Column]:
    """(type, bits) of the cheapest of three layouts, one more bit for the two that need a mark; ties to the earlier."""
    ef, bitmap = ef + 1, bitmap + 1
    kind = F.when(ones.isNotNull() & (ones <= ef) & (ones <= bitmap), "all_ones").when(ef <= bitmap, "elias_fano").otherwise("bitmap")
    return kind, F.least(ones, ef, bitmap)


def indexed(u: Column, n: Column) -> tuple[Column, Column]:
    return cheapest(all_ones_bits(u, n), elias_fano_bits(u, n), bitmap_bits(u, n))


def strict(u: Column, n: Column) -> tuple[Column, Column]:
    return cheapest(all_ones_bits(u, n), strict_elias_fano_bits(u, n, zeros=63), bitmap_bits(u, n, ranks=63))


def list_header_bits(occurrences: Column) -> Column:
    return gamma_bits(occurrences - 1) + F.when(occurrences > 1, ceil_log2(occurrences + 1)).otherwise(0)


def magnitude(x: Column) -> Column:
    """0 for 1, else the logarithm rounded up; for x > 0."""
    return ceil_log2(x)


def selector(x: Column) -> Column:
    """Selector of the magnitude of x > 0."""
    return F.element_at(F.array(*map(F.lit, MAG2SEL)), (magnitude(x) + 1).cast("int")).cast("long")


def msb_symbol(x: Column) -> Column:
    """Symbol of x > 0: the value, or its leading byte with a class for the bytes that follow as exceptions."""
    return F.when(x <= 1 << 8, x).when(x <= 1 << 16, F.shiftright(x, 8) + 256).when(x <= 1 << 24, F.shiftright(x, 16) + 512).otherwise(F.shiftright(x, 24) + 768)


def exception_bytes(x: Column) -> Column:
    return F.when(x <= 1 << 8, 0).when(x <= 1 << 16, 1).when(x <= 1 << 24, 2).otherwise(3).cast("long")
