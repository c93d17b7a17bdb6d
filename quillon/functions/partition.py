"""Near-optimal partitions of a sorted list: shortest path over ends of partitions, with partitions limited by cost."""

from __future__ import annotations

#: Slack of the cost of long partitions, growth of the cost limits, bits that each partition costs besides.
EPS1, EPS2, FIXED = 0.03, 0.3, 64


def _ceil_log2(x: int) -> int:
    return (x - 1).bit_length() if x > 1 else 0


def indexed_bits(u: int, n: int) -> int:
    """Bits of the cheapest of all-ones, Elias-Fano and bitmap, as in functions.bits."""
    if u == n:
        return 0
    low = (u // n).bit_length() - 1 if u > n else 0
    high = n + (u >> low) + 2
    pointer = _ceil_log2(high)
    ef = ((high - n) >> 9) * pointer + (n >> 8) * pointer + high + n * low
    bitmap = (u >> 9) * _ceil_log2(n + 1) + (n >> 8) * _ceil_log2(u) + u
    return min(ef, bitmap) + 1


def optimal_partition(values: list[int], universe: int, eps1: float = EPS1, eps2: float = EPS2, fixed: int = FIXED, cost=indexed_bits) -> list[int]:
    """Ends of the partitions.

    From each start, for limits that grow by 1 + eps2 up to the least cost over eps1, only the longest partition within the
    limit is tried: as costs grow with the length, the result costs at most about (1 + eps1)(1 + eps2) times the best."""
    n = len(values)
    whole = cost(universe, n) + fixed
    least = cost(1, 1) + fixed
    limits, limit = [], float(least)
    while limit < least / eps1 and limit < whole * (1 + eps2):
        limits.append(limit)
        limit *= 1 + eps2
    best, came = [0.0] + [float(whole)] * n, [0] * (n + 1)
    reach = [0] * len(limits)
    for i in range(n):
        base = values[0] if i == 0 else values[i - 1] + 1
        tried = i
        for k, limit in enumerate(limits):
            end = max(reach[k], i + 1, tried)
            while True:
                c = cost(values[end - 1] - base + 1, end - i) + fixed
                if best[i] + c < best[end]:
                    best[end], came[end] = best[i] + c, i
                if c >= limit or end == n:
                    break
                end += 1
            reach[k] = tried = end
            if end == n:
                break
    ends, at = [], n
    while at:
        ends.append(at)
        at = came[at]
    return ends[::-1]
