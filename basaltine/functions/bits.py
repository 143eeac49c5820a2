"""Unsigned 32-bit arithmetic in longs, which never overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = (1 << 32) - 1


def u32(value: Column) -> Column:
    """The low 32 bits."""
    return value.bitwiseAND(F.lit(MASK32))


def multiply32(value: Column, factor: int) -> Column:
    """The product modulo 2^32 of a 32-bit value, by 16-bit halves."""
    low = value.bitwiseAND(F.lit(65535)) * F.lit(factor)
    high = (F.shiftright(value, 16) * F.lit(factor)).bitwiseAND(F.lit(65535))
    return u32(low + F.shiftleft(high, 16))


def mix32(value: Column) -> Column:
    """A 32-bit finaliser of two multiplications and three xor-shifts. Its constants are fixed values."""
    h = u32(value.cast("bigint"))
    h = multiply32(h.bitwiseXOR(F.shiftright(h, 16)), 0x7FEB352D)
    h = multiply32(h.bitwiseXOR(F.shiftright(h, 15)), 0x846CA68B)
    return h.bitwiseXOR(F.shiftright(h, 16))


def wrap_i32(value: Column) -> Column:
    """A long as a signed 32-bit integer that wraps."""
    low = u32(value)
    return F.when(low >= (1 << 31), low - (1 << 32)).otherwise(low).cast("int")


def decode_u32(data: Column, big_endian: bool = False) -> Column:
    """array<bigint>: binary as 32-bit unsigned integers; a length that 4 does not divide fails the query."""
    text = F.hex(data)

    def word(i: Column) -> Column:
        byte = [F.substring(text, i * 8 + 2 * k + 1, F.lit(2)) for k in range(4)]
        return F.conv(F.concat(*(byte if big_endian else byte[::-1])), 16, 10).cast("bigint")

    n = F.octet_length(data)
    words = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), (n / 4).cast("int") - 1), word))
    return F.when(n % 4 != 0, F.raise_error(F.lit("the length is no multiple of 4"))).otherwise(words)
