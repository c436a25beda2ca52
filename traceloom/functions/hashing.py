"""Wrapping 64-bit arithmetic and FNV-1a, as columns and in numpy.

Column sums and products of BIGINT raise on overflow under ANSI rules, so the column forms work on 32-bit halves whose
products can't overflow; shifts and bit operations wrap by themselves. Unsigned values are carried as BIGINT with the
same bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom.constants import FNV_OFFSET, FNV_PRIME, signed

LOW = 0xFFFFFFFF
SIGN = -(1 << 63)


# ---- columns ---------------------------------------------------------------------------------------------------------


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(_low(low))


def wrap_add(x: Column, y: Column) -> Column:
    """x + y modulo 2**64."""
    low = _low(x) + _low(y)
    return _join(_high(x) + _high(y) + _high(low), low)


def wrap_mul(x: Column, factor: int | Column) -> Column:
    """x * factor modulo 2**64, from 32-bit halves of x and 16-bit parts of the factor."""
    out: Column | None = None
    for k in range(4):
        if isinstance(factor, int):
            if not factor >> (16 * k) & 0xFFFF:
                continue
            part = F.lit(factor >> (16 * k) & 0xFFFF).cast("long")
        else:
            part = F.shiftrightunsigned(factor, 16 * k).bitwiseAND(F.lit(0xFFFF))
        low = _low(x) * part
        term = _join(_high(x) * part + _high(low), low)
        term = F.shiftleft(term, 16 * k) if k else term
        out = term if out is None else wrap_add(out, term)
    return F.lit(0).cast("long") if out is None else out


def fnv_step(h: Column, byte: Column) -> Column:
    """One byte of FNV-1a. The prime is 2**40 + 0x1b3, so two small products are enough."""
    x = h.bitwiseXOR(byte)
    small = F.lit(FNV_PRIME & 0xFFFF)
    low = _low(x) * small
    return _join(_high(x) * small + _high(low) + F.shiftleft(_low(x), FNV_PRIME.bit_length() - 1 - 32), low)


def fnv1a(bytes_: Column) -> Column:
    """FNV-1a of an array of byte values (BIGINT)."""
    return F.aggregate(bytes_, F.lit(signed(FNV_OFFSET)), fnv_step)


def le_bytes(x: Column) -> Column:
    """The eight bytes of a BIGINT, lowest first, as an array of BIGINT."""
    return F.array(*(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) for k in range(8)))


def utf8_bytes(s: Column) -> Column:
    """The bytes of a string's UTF-8 form, as an array of BIGINT."""
    raw = F.hex(F.encode(s, "UTF-8"))
    pairs = F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2))
    read = F.transform(pairs, lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.length(raw) == 0, F.array().cast("array<bigint>")).otherwise(read)


def mix(*values: Column) -> Column:
    """FNV-1a over the little-endian bytes of BIGINT values."""
    return fnv1a(F.concat(*(le_bytes(v) for v in values)))


def mix_array(values: Column) -> Column:
    """``mix`` over the elements of an array of BIGINT."""
    return fnv1a(F.flatten(F.transform(values, le_bytes)))


def unsigned_order(x: Column) -> Column:
    """A BIGINT whose signed order is the unsigned order of ``x``; its own inverse."""
    return x.bitwiseXOR(F.lit(SIGN))


# ---- numpy -----------------------------------------------------------------------------------------------------------

_PRIME = np.uint64(FNV_PRIME)


def np_start(n: int) -> np.ndarray:
    return np.full(n, FNV_OFFSET, np.uint64)


def np_byte(h: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return (h ^ np.asarray(byte, np.uint64)) * _PRIME


def np_word(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Continue with the eight little-endian bytes of each word."""
    w = np.asarray(word).astype(np.uint64)
    for k in range(8):
        h = (h ^ (w >> np.uint64(8 * k) & np.uint64(255))) * _PRIME
    return h


def np_mix(*words: np.ndarray | int, n: int) -> np.ndarray:
    h = np_start(n)
    for w in words:
        h = np_word(h, w)
    return h


def py_fnv(data: bytes, h: int = FNV_OFFSET) -> int:
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h
