"""CRC-32 of a byte string from those of its parts, so that a text spread over several blocks is never put together."""

from __future__ import annotations

from functools import lru_cache

#: The polynomial of CRC-32, lowest bit first.
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo POLYNOMIAL; the highest bit is the coefficient of 1."""
    product = 0
    while a:
        if a & 0x80000000:
            product ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return product


@lru_cache(64)
def _doubled(k: int) -> int:
    """x to the power 8 * 2**k."""
    return 0x00800000 if k == 0 else _times(_doubled(k - 1), _doubled(k - 1))


def joined_crc32(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two strings, one after the other, from theirs and the length of the second."""
    for k in range(second_bytes.bit_length()):
        if second_bytes >> k & 1:
            first = _times(_doubled(k), first)
    return first ^ second
