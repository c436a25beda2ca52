"""From traces to fingerprints: tokens, shingles, signatures and band keys.

Two Arrow passes with one shuffle between them: the traces of a key that are read together are reduced to their distinct
shingles; these sets meet by key; each key's union is hashed into its signature. Shingles never span traces, complexity
is the largest of a key's traces, ``capped`` holds if any trace was cut off.

The union of a key with very many effects doesn't fit one task. Such keys (found by a count over one narrow column) go
another way to the same figures: their distinct (key, shingle) rows lie spread over all tasks, each task reduces its own to
a count and 128 slot minima, and minima of parts combine by minimum again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import effects as E
from traceloom.functions import signature as S
from traceloom.functions.hashing import unsigned_order
from traceloom.operators.shared import spread

_FIELDS = ("seq", "kind", "region", "region_k", "off", "val", "val_k", "sym", "nr")
_TEXT = ("kind", "region", "val", "sym")
#: Effects of a key from which on its shingles are reduced in many tasks.
MANY_EFFECTS = 4_000_000


def _flat(b: pa.RecordBatch, first: int) -> tuple[np.ndarray, dict[str, np.ndarray | E.Coded]]:
    """Effects of a batch in flat arrays, ordered by ``seq``, each ``seq`` once; with the trace number of each."""
    lists = [b.column(first + k) for k in range(len(_FIELDS))]
    lengths = pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(b.num_rows), lengths)
    flat = dict(zip(_FIELDS, (x.flatten() for x in lists)))
    at = np.flatnonzero(pc.is_valid(flat["seq"]).to_numpy(zero_copy_only=False))
    row, seq = row[at], pc.fill_null(flat["seq"], 0).to_numpy(zero_copy_only=False)[at]
    if not np.all((row[1:] > row[:-1]) | (seq[1:] > seq[:-1])):
        order = np.lexsort((seq, row))
        row, seq, at = row[order], seq[order], at[order]
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (seq[1:] != seq[:-1])
        row, at = row[once], at[once]
    return row, {k: E.Coded(x).take(at) if k in _TEXT else pc.fill_null(x.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)[at] for k, x in flat.items()}


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _wide(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64)))


def trace_shingles(traces: DataFrame, key: str = "func_id", united: bool = False, scan: bool = True) -> DataFrame:
    """``key``, ``complexity``, ``capped``, ``shingles`` (distinct) of every trace. Null effects count as none.

    With ``united`` the traces of one key that are read in one batch give one row. ``scan`` tells that ``traces`` is read from
    a table; if that gives fewer partitions than there are cores, the rows are spread first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            row, f = _flat(b, 2)
            tokens = E.np_tokens(*(f[k] for k in _FIELDS[1:]))
            total = np.bincount(row, E.np_complexity(f["kind"], f["val"]), minlength=n).astype(np.int64)
            capped, keys, group = b.column(1).to_numpy(zero_copy_only=False), b.column(0), None
            if united:
                codes = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                _, first, group = np.unique(codes, return_index=True, return_inverse=True)
                most, any_ = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
                np.maximum.at(most, group, total)
                np.logical_or.at(any_, group, capped)
                total, capped, keys = most, any_, keys.take(pa.array(first))
            shingle_row, shingle = S.np_shingles(tokens, np.bincount(row, minlength=n), group)
            yield pa.RecordBatch.from_arrays([keys, pa.array(total), pa.array(capped), _lists(shingle, shingle_row, len(keys))], ["_key", "complexity", "capped", "shingles"])

    fields = [F.col(f"effects.{k}").alias(k) for k in _FIELDS]
    rows = traces.select(F.col(key).alias("_key"), F.coalesce("capped", F.lit(False)).alias("capped"), *fields)
    rows = spread(rows) if scan and not rows.isStreaming else rows
    kind = rows.schema["_key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_key {kind}, complexity bigint, capped boolean, shingles array<bigint>")
    return out.withColumnRenamed("_key", key)


def _minima(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles and signature of every row of a batch whose first column holds shingles."""
    n = b.num_rows
    lengths = pc.fill_null(pc.list_value_length(b.column(0)), 0).to_numpy(zero_copy_only=False)
    value = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row, value = S.np_distinct(np.repeat(np.arange(n), lengths), value)
    count = np.bincount(row, minlength=n)
    filled = np.flatnonzero(count)
    return count, S.np_minhash(value, (np.cumsum(count) - count)[filled], n, filled)


def sign(unions: DataFrame, key: str = "func_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep``, ``shingles`` (count), ``sig`` and ``bands`` from ``key`` and ``shingles`` (array, repeats allowed).

    No shingles give 128 zero slots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, sigs = _minima(b)
            kept = [b.column(k) for k in range(1, b.num_columns)]
            made = [pa.array(count.astype(np.int64)), _wide(sigs), _wide(S.np_band_keys(sigs))]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*b.schema.names[1:], "shingles", "sig", "bands"])

    rows = unions.select("shingles", key, *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{fields}, shingles bigint, sig array<bigint>, bands array<bigint>")


def _slot_array(slots: Column) -> Column:
    return F.transform(F.array_sort(slots), lambda x: x["value"])


def combine_minima(parts: DataFrame, key: str) -> DataFrame:
    """``key``, ``shingles`` and ``sig`` from parts of a key that share no shingle (``key``, ``n``, ``sig``): counts add up, each slot is
    the unsigned minimum of the parts' slots. Parts without shingles must be left out, their zeros would win."""
    slots = parts.select(key, F.posexplode("sig").alias("slot", "v"))
    low = slots.groupBy(key, "slot").agg(unsigned_order(F.min(unsigned_order(F.col("v")))).alias("value"))
    sigs = low.groupBy(key).agg(_slot_array(F.collect_list(F.struct("slot", "value"))).alias("sig"))
    return parts.groupBy(key).agg(F.sum("n").alias("shingles")).join(sigs, key)


def _spread_fingerprints(traces: DataFrame, key: str) -> DataFrame:
    """``fingerprints`` of keys with very many effects; no task holds a key's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = pc.dictionary_encode(b.column(0))
                order = np.argsort(codes.indices.to_numpy(), kind="stable")
                lists = _lists(b.column(1).to_numpy()[order], codes.indices.to_numpy()[order], len(codes.dictionary))
                count, sigs = _minima(pa.RecordBatch.from_arrays([lists], ["s"]))
                yield pa.RecordBatch.from_arrays([codes.dictionary, pa.array(count.astype(np.int64)), _wide(sigs)], ["_key", "n", "sig"])

    sets = trace_shingles(traces, key, united=True, scan=False)
    facts = sets.groupBy(key).agg(F.max("complexity").alias("complexity"), F.bool_or("capped").alias("capped"))
    single = sets.select(F.col(key).alias("_key"), F.explode("shingles").alias("s")).distinct()
    parts = single.mapInArrow(run, f"_key {single.schema['_key'].dataType.simpleString()}, n bigint, sig array<bigint>")
    both = facts.join(combine_minima(parts.withColumnRenamed("_key", key), key), key)
    return both.select(key, "complexity", "shingles", "capped", "sig", S.band_keys(F.col("sig")).alias("bands"))


def fingerprints(traces: DataFrame, key: str = "func_id") -> DataFrame:
    """``key``, ``complexity``, ``shingles``, ``capped``, ``sig`` and ``bands`` of every key that has a trace.

    Traces may arrive in any order, twice, or without effects; repeated traces change nothing. Columns beyond ``key``,
    ``effects`` and ``capped`` are left out. Building the plan counts the effects of each key once.
    """
    size = F.sum(F.size("effects.seq")).alias("_n")
    many = traces.where(F.col(key).isNotNull()).groupBy(key).agg(size).where(F.col("_n") > MANY_EFFECTS).select(key)
    some = (traces.agg(size).first()["_n"] or 0) > MANY_EFFECTS and not many.isEmpty()
    few = traces.join(many, key, "left_anti") if some else traces
    union = trace_shingles(few, key, united=True, scan=not some).groupBy(key).agg(
        F.max("complexity").alias("complexity"), F.bool_or("capped").alias("capped"), F.flatten(F.collect_list("shingles")).alias("shingles"),
    )
    out = sign(union, key, ("complexity", "capped")).select(key, "complexity", "shingles", "capped", "sig", "bands")
    return out.unionByName(_spread_fingerprints(traces.join(many, key, "left_semi"), key)) if some else out
