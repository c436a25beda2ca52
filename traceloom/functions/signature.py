"""Shingles, minhash signatures, band keys and similarity, as columns and in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.functions import hashing as H
from traceloom.functions.binding import let

_MASK = 0xFFFFFFFFFFFFFFFF


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Odd multiplier and addend of each slot, as uint64."""
    a = [((C.PERM_A[i % 8] * (i | 1) + C.PERM_A_ADD) & _MASK) | 1 for i in range(C.SLOTS)]
    b = [(C.PERM_B[i % 8] + i * C.PERM_B_STEP) & _MASK for i in range(C.SLOTS)]
    return np.array(a, np.uint64), np.array(b, np.uint64)


# ---- columns ---------------------------------------------------------------------------------------------------------


def shingles(tokens: Column) -> Column:
    """Distinct hashes of all tokens and, from three tokens on, of all windows of three. Empty for no tokens."""

    def of(t: Column) -> Column:
        ones = F.transform(t, lambda x: H.mix(F.lit(C.UNIGRAM).cast("long"), x))
        threes = F.transform(
            F.sequence(F.lit(0), F.size(t) - C.SHINGLE),
            lambda i: H.mix(F.lit(C.TRIGRAM).cast("long"), *(F.get(t, i + k) for k in range(C.SHINGLE))),
        )
        return F.array_distinct(F.when(F.size(t) >= C.SHINGLE, F.concat(ones, threes)).otherwise(ones))

    return let(tokens, of)


def band_keys(sig: Column) -> Column:
    """The 32 keys of a signature: FNV-1a of each run of four slots. Equal runs in different bands have equal keys."""
    runs = F.sequence(F.lit(0), F.lit(C.BANDS - 1))
    return F.transform(runs, lambda i: H.mix_array(F.slice(sig, i * C.BAND_ROWS + 1, C.BAND_ROWS)))


def equal_slots(a: Column, b: Column) -> Column:
    """Agreeing slots of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def similarity(a: Column, b: Column) -> Column:
    """Share of agreeing slots; 0 for null, empty or unequally long signatures."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits, equal_slots(a, b) / F.size(a)).otherwise(F.lit(0.0))


def encode_signature(sig: Column) -> Column:
    """Little-endian bytes of a signature, as stored in a corpus image."""
    hexed = F.transform(sig, lambda x: F.lpad(F.hex(x), 16, "0"))
    turned = F.transform(hexed, lambda h: F.concat(*(F.substring(h, 15 - 2 * k, 2) for k in range(8))))
    return F.unhex(F.array_join(turned, ""))


def decode_signature(blob: Column) -> Column:
    """A signature from its bytes; a trailing partial word is left out."""

    def word(i: Column) -> Column:
        out = None
        for k in range(8):
            byte = F.conv(F.hex(F.substring(blob, i * 8 + (k + 1), F.lit(1))), 16, 10).cast("long")
            byte = F.shiftleft(byte, 8 * k) if k else byte
            out = byte if out is None else out.bitwiseOR(byte)
        return out

    words = F.floor(F.length(blob) / 8).cast("int")
    return F.when(words > 0, F.transform(F.sequence(F.lit(0), words - 1), word)).otherwise(F.when(blob.isNotNull(), F.array().cast("array<bigint>")))


# ---- numpy -----------------------------------------------------------------------------------------------------------


def np_shingles(tokens: np.ndarray, lengths: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (trace number, shingle) of flat tokens whose traces have ``lengths``, sorted; windows never span traces.
    With ``group`` (a number per trace) the shingles of a group's traces are united."""
    n = len(tokens)
    row = np.repeat(np.arange(len(lengths)), lengths)
    ones = H.np_mix(C.UNIGRAM, tokens, n=n)
    at = np.flatnonzero(row[2:] == row[:-2]) if n >= C.SHINGLE else np.zeros(0, np.int64)
    threes = H.np_mix(C.TRIGRAM, tokens[at], tokens[at + 1], tokens[at + 2], n=len(at))
    of = row if group is None else group[row]
    return np_distinct(np.concatenate([of, of[at]]), np.concatenate([ones, threes]))


def np_distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def np_minhash(values: np.ndarray, starts: np.ndarray, n: int, filled: np.ndarray) -> np.ndarray:
    """(n, 128) signatures; ``starts`` are the first places in ``values`` of the rows ``filled``, other rows are zero."""
    out = np.zeros((n, C.SLOTS), np.uint64)
    if len(values):
        for i, (a, b) in enumerate(zip(*permutations())):
            v = values * a + b
            v ^= v >> np.uint64(C.PERM_SHIFT)
            out[filled, i] = np.minimum.reduceat(v, starts)
    return out


def np_band_keys(sigs: np.ndarray) -> np.ndarray:
    """(n, 32) band keys of (n, 128) signatures."""
    runs = sigs.reshape(-1, C.BANDS, C.BAND_ROWS).astype(np.uint64)
    h = np.full(runs.shape[:2], 1, np.uint64) * np.uint64(C.FNV_OFFSET)
    for k in range(C.BAND_ROWS):
        h = H.np_word(h, runs[:, :, k])
    return h
