"""Repeated consecutive events in sequences (problem 5): boundary interval lookup.

The events of a batch lie in flat arrays; the places where a run starts form one sorted array, each event finds its run by
binary search in it, and runs are aggregated. Two forms of input:

* ``collapse_runs``: a sequence is an array in one row, so nothing is shuffled (a scan of few partitions is spread over the
  cores first).
* ``collapse_event_rows``: one row per event. Rows are range-partitioned by (entity, order), so an entity with very many
  events is cut into chunks over several tasks; each chunk's runs are found in its task, and only the first and last run
  of every chunk (two rows per task) are looked at again to join runs over the borders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators.shared import materialize, spread

#: Fields that must agree for effects to be nearly equal; ``off`` and ``val_k`` may differ.
SAME = ("kind", "region", "region_k", "val", "sym", "nr")


def _codes(flat: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are; null is a value of its own."""
    return pc.fill_null(pc.dictionary_encode(flat).indices, -1).to_numpy(zero_copy_only=False)


def _runs(ids: pa.Array, seqs: pa.Array, ics: pa.Array, fields: list[pa.Array], least: int) -> pa.RecordBatch:
    lengths = pc.fill_null(pc.list_value_length(seqs), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(ids)), lengths)
    seq_flat, ic_flat = seqs.flatten(), ics.flatten()
    codes = [_codes(f.flatten()) for f in fields]
    place = np.flatnonzero(pc.is_valid(seq_flat).to_numpy(zero_copy_only=False))
    row, seq = row[place], pc.fill_null(seq_flat, 0).to_numpy(zero_copy_only=False)[place]
    if len(row) > 1 and not np.all((row[1:] > row[:-1]) | (seq[1:] > seq[:-1])):
        order = np.lexsort((seq, row))  # stable: of elements under one seq the first delivered stays
        row, seq, place = row[order], seq[order], place[order]
        once = np.concatenate([[True], (row[1:] != row[:-1]) | (seq[1:] != seq[:-1])])
        row, seq, place = row[once], seq[once], place[once]
    n = len(row)
    starts_here = np.ones(n, bool)
    if n:
        starts_here[1:] = row[1:] != row[:-1]
        for c in codes:
            v = c[place]
            starts_here[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(starts_here)
    run_of = np.searchsorted(starts, np.arange(n), side="right") - 1
    count = np.bincount(run_of, minlength=len(starts))
    first = starts[count >= least]
    count = count[count >= least]
    last = first + count - 1
    ic_of = lambda k: ic_flat.take(pa.array(place[k]))
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(row[first])), pa.array(seq[first], pa.int32()), pa.array(seq[last], pa.int32()),
            pa.array(count, pa.int64()), pc.subtract(ic_of(last), ic_of(first)), *(f.flatten().take(pa.array(place[first])) for f in fields),
        ],
        ["_id", "first_seq", "last_seq", "n_effects", "duration", *SAME],
    )


def collapse_runs(traces: DataFrame, least: int = 1, id_col: str = "trace_id") -> DataFrame:
    """Runs of consecutive nearly equal effects of each trace, as one row per run of at least ``least`` effects.

    Effects are ordered by ``seq``; of elements under one ``seq`` only the first delivered counts, elements without
    ``seq`` don't. Two neighbours belong to one run if they agree in kind, region, region_k, val, sym and nr (null
    equals null). Returns ``id_col``, ``first_seq``, ``last_seq``, ``n_effects``, ``duration`` (difference in ``ic``, null
    if either is) and the shared fields. Null or empty effects give no row; traces delivered again are traces of their
    own; further columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _runs(b.column(0), b.column(1), b.column(2), [b.column(k) for k in range(3, 3 + len(SAME))], least)

    names = ("seq", "ic", *SAME)
    # field by field, so that only these fields are read
    rows = spread(traces.select(F.col(id_col).alias("_id"), *(F.col(f"effects.{c}").alias(c) for c in names)))
    inner = {f.name: f.dataType.simpleString() for f in traces.schema["effects"].dataType.elementType}
    fields = ", ".join(f"{c} {inner[c]}" for c in SAME)
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, first_seq int, last_seq int, n_effects bigint, duration bigint, {fields}"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _chunk_runs(batches: Iterator[pa.RecordBatch], fields: Sequence[str], least: int) -> Iterator[pa.RecordBatch]:
    """Runs of one chunk of sorted events (``_id, _at, _time, *fields``); the run at a batch's end stays open until the next."""
    names = ["_id", "first_seq", "last_seq", "n_effects", "_t0", "_t1", *fields, "_head", "_tail"]
    last, opened, head = None, None, True  # last event of the open run; its first place, first time and count

    def out(rows: pa.RecordBatch, end: np.ndarray, first: list, start_time: pa.Array, count: np.ndarray, tail: bool) -> pa.RecordBatch:
        nonlocal head
        flags = np.zeros(len(end), bool)
        flags[:1] = head
        kept = (count >= least) | flags | tail
        head = head and not len(end)
        at = pa.array(end)
        cols = [rows.column(0).take(at), pa.array(first, pa.int64()), rows.column(1).take(at), pa.array(count, pa.int64()), start_time, rows.column(2).take(at)]
        cols += [rows.column(k).take(at) for k in range(3, rows.num_columns)] + [pa.array(flags), pa.array(np.full(len(end), tail))]
        return pa.RecordBatch.from_arrays(cols, names).filter(pa.array(kept))

    for b in batches:
        if not b.num_rows:
            continue
        rows = b if last is None else pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        entity, at = _codes(rows.column(0)), rows.column(1).to_numpy()
        once = np.ones(len(at), bool)
        once[1:] = (entity[1:] != entity[:-1]) | (at[1:] != at[:-1])
        place = np.flatnonzero(once)
        changed = np.zeros(len(place), bool)
        changed[0] = True
        for c in (entity, *(_codes(rows.column(k)) for k in range(3, rows.num_columns))):
            v = c[place]
            changed[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(changed)
        run_of = np.searchsorted(starts, np.arange(len(place)), side="right") - 1
        count = np.bincount(run_of, minlength=len(starts))
        first = at[place[starts]].tolist()
        times = rows.column(2).take(pa.array(place[starts])).to_pylist()
        if opened is not None:
            first[0], times[0] = opened[0], opened[1]
            count[0] += opened[2] - 1
        end = place[np.append(starts[1:], len(place)) - 1]
        if len(end) > 1:
            yield out(rows, end[:-1], first[:-1], pa.array(times[:-1], pa.int64()), count[:-1], False)
        last, opened = rows.slice(int(end[-1]), 1), (first[-1], times[-1], int(count[-1]))
    if last is not None:
        yield out(last, np.zeros(1, np.int64), [opened[0]], pa.array([opened[1]], pa.int64()), np.array([opened[2]]), True)


def collapse_event_rows(
    events: DataFrame, least: int = 1, entity: str = "trace_id", order: str = "seq", time: str = "ic", same: Sequence[str] = SAME, chunks: int | None = None
) -> DataFrame:
    """Runs of consecutive nearly equal events of each entity, from one row per event: ``entity, first_seq, last_seq,
    n_effects, duration, *same``.

    Events of an entity are ordered by ``order`` (a whole number); of several under one place the one with the smallest
    ``time`` and fields counts once, events without a place don't. Neighbours belong to one run if they agree in ``same``
    (null equals null). ``duration`` is the difference in ``time``, null if either end's is. Runs of fewer than ``least``
    events are left out. A null entity is an entity of its own; an empty table gives no rows; further columns are left
    out, so their names can't clash. ``chunks`` sets the number of ranges (by default Spark's number of shuffle
    partitions); an entity of any size is cut between them.
    """
    whole = [F.col(order).cast("long").alias("_at"), F.col(time).cast("long").alias("_time")]
    rows = events.where(F.col(order).isNotNull()).select(F.col(entity).alias("_id"), *whole, *same)
    placed = rows.repartitionByRange(*([chunks] if chunks else []), "_id", "_at").sortWithinPartitions("_id", "_at", "_time", *same)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"_id {kinds['_id']}, first_seq bigint, last_seq bigint, n_effects bigint, _t0 bigint, _t1 bigint, "
    schema += "".join(f"`{c}` {kinds[c]}, " for c in same) + "_head boolean, _tail boolean"
    # written once: a range partitioning that is computed twice may cut elsewhere
    found = materialize(placed.mapInArrow(lambda batches: _chunk_runs(batches, same, least), schema), "runs")
    inner = found.where("NOT _head AND NOT _tail")

    # two rows per chunk at most: a chunk's last run goes on in the next chunk's first
    by = Window.partitionBy("_id").orderBy("first_seq")
    fields = F.struct(*same)
    goes_on = F.coalesce(F.lag("_tail").over(by), F.lit(False)) & F.col("_head") & F.lag(fields).over(by).eqNullSafe(fields)
    edges = found.where("_head OR _tail").withColumn("_new", (~goes_on).cast("int"))
    edges = edges.withColumn("_g", F.sum("_new").over(by))
    joined = edges.groupBy("_id", "_g").agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("n_effects").alias("n_effects"),
        F.min_by("_t0", "first_seq").alias("_t0"), F.max_by("_t1", "last_seq").alias("_t1"), F.min_by(fields, "first_seq").alias("_f"),
    )
    joined = joined.where(F.col("n_effects") >= least).select("_id", "first_seq", "last_seq", "n_effects", "_t0", "_t1", *(F.col(f"_f.{c}").alias(c) for c in same))
    out = inner.select(joined.columns).unionByName(joined)
    return out.select(F.col("_id").alias(entity), "first_seq", "last_seq", "n_effects", (F.col("_t1") - F.col("_t0")).alias("duration"), *same)
