"""Frequent subsequences across many sequences (problem 4): bitmap sequence mining.

Each sequence's positions of a step are bits. A pattern's bitmap marks where its last step can stand; extending it by a
step shifts (all bits after the first one set) and intersects with the step's bitmap; a sequence supports the pattern if
a bit is left. Patterns grow depth-first.

The corpus is mined in parts of whole entities. A pattern that is frequent in the corpus reaches its share of the
threshold in at least one part, so the union of the parts' frequent patterns holds every answer; a second pass counts
those candidates in all parts. Supports are exact.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.binding import let
from traceloom.operators.shared import materialize, spread

PART_ENTITIES = 8192
PART_SEQUENCES = 400_000
#: An entity with more distinct sequences than this is cut into chunks.
CHUNK = 4096
#: Up to this many frequent steps a step is coded in two bytes, beyond it in four.
SHORT_CODES = 1 << 16
SEPARATOR = " > "

_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


class Bitmaps:
    """Vertical bitmaps of coded sequences; sequences of similar length share a width in words."""

    def __init__(self, entities: np.ndarray, sequences: list[np.ndarray]):
        self.classes: list[tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]] = []
        sizes = np.array([len(s) for s in sequences], np.int64)
        widths = np.where(sizes > 0, 2 ** np.ceil(np.log2(np.maximum(1, -(-sizes // 64)))).astype(np.int64), 0)
        for w in np.unique(widths[widths > 0]):
            mine = np.flatnonzero(widths == w)
            mine = mine[np.argsort(entities[mine], kind="stable")]
            seqs = [sequences[i] for i in mine]
            t = np.repeat(np.arange(len(mine)), sizes[mine])
            code = np.concatenate(seqs).astype(np.int64)
            starts = np.cumsum(sizes[mine]) - sizes[mine]
            p = np.arange(len(t)) - starts[t]
            order = np.lexsort((p, t, code))
            t, code, p = t[order], code[order], p[order]
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (code[1:] != code[:-1])])
            g = np.cumsum(new) - 1
            words = np.zeros((int(g[-1]) + 1, int(w)), np.uint64)
            np.bitwise_or.at(words, (g, p >> 6), _ONE << (p & 63).astype(np.uint64))
            rows, codes = t[new], code[new]
            cut = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            ends = np.append(cut[1:], len(codes))
            items = {int(codes[a]): (rows[a:b], words[a:b]) for a, b in zip(cut, ends)}
            self.classes.append((entities[mine], items))

    @staticmethod
    def after_first(words: np.ndarray) -> np.ndarray:
        """Ones at all places after the first one of each row."""
        some = words != 0
        k = np.argmax(some, axis=1)
        at = np.arange(len(words))
        w = words[at, k]
        low = w & (~w + _ONE)
        out = np.where(np.arange(words.shape[1])[None, :] > k[:, None], _ALL, np.uint64(0))
        out[at, k] = ~(low | (low - _ONE))
        return out

    def start(self, item: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
        return [items.get(item) for _, items in self.classes]

    def shifted(self, state: list) -> list:
        return [None if s is None else (s[0], self.after_first(s[1])) for s in state]

    def extend(self, shifted: list, item: int) -> list:
        out = []
        for s, (_, items) in zip(shifted, self.classes):
            other = items.get(item)
            if s is None or other is None:
                out.append(None)
                continue
            at = np.searchsorted(other[0], s[0])
            at[at == len(other[0])] = 0
            hit = np.flatnonzero(other[0][at] == s[0])
            words = s[1][hit] & other[1][at[hit]]
            left = np.flatnonzero(words.any(axis=1))
            out.append((s[0][hit[left]], words[left]) if len(left) else None)
        return out

    def entities(self, state: list) -> np.ndarray:
        found = [entities[s[0]] for s, (entities, _) in zip(state, self.classes) if s is not None]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def items(self) -> list[int]:
        return sorted(set().union(*(items for _, items in self.classes)))


def mine(
    bitmaps: Bitmaps, least: int, shortest: int, longest: int, allowed: dict[tuple, set[int]] | None = None
) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Patterns with at least ``least`` entities, depth-first, with the entities; only along ``allowed`` prefixes if given."""

    def grow(pattern: tuple, state: list, items: Iterable[int]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        shifted, good = bitmaps.shifted(state), []
        wanted = items if allowed is None else sorted(allowed.get(pattern, ()))
        for i in wanted:
            nxt = bitmaps.extend(shifted, i)
            who = bitmaps.entities(nxt)
            if len(who) >= least:
                good.append((i, nxt, who))
        names = [i for i, _, _ in good]  # a step that fails here fails in every longer pattern
        for i, nxt, who in good:
            p = (*pattern, i)
            if len(p) >= shortest:
                yield p, who
            if len(p) < longest:
                yield from grow(p, nxt, names)

    items = bitmaps.items()
    for i in items if allowed is None else sorted(allowed.get((), ())):
        state = bitmaps.start(i)
        if len(bitmaps.entities(state)) >= least:
            yield from grow((i,), state, items)


def _prefixes(patterns: Iterable[tuple[int, ...]]) -> dict[tuple, set[int]]:
    out: dict[tuple, set[int]] = defaultdict(set)
    for p in patterns:
        for k in range(len(p)):
            out[p[:k]].add(p[k])
    return out


def step_sequences(traces: DataFrame) -> DataFrame:
    """``func_id`` and ``steps`` of every trace that has a step: its named calls and its syscalls in the order of ``seq``."""
    named = lambda e: (e["kind"] == "call") & e["sym"].isNotNull()
    system = lambda e: (e["kind"] == "syscall") & e["nr"].isNotNull()
    text = lambda e: F.when(e["kind"] == "call", e["sym"]).otherwise(F.concat(F.lit("sys:"), e["nr"].cast("string")))

    def once(sorted_: Column) -> Column:
        first = F.filter(sorted_, lambda x, i: (i == 0) | (F.get(sorted_, i - 1)["seq"] != x["seq"]))
        return F.transform(first, lambda x: x["step"])

    # field by field, so that only these fields are read
    fields = F.arrays_zip(*(F.col(f"effects.{c}").alias(c) for c in ("seq", "kind", "sym", "nr")))
    kept = F.filter(fields, lambda e: e["seq"].isNotNull() & (named(e) | system(e)))
    pairs = F.transform(kept, lambda e: F.struct(e["seq"].alias("seq"), text(e).alias("step")))
    steps = traces.select("func_id", let(F.array_sort(pairs), once).alias("steps"))
    return steps.where(F.size("steps") > 0)


def _gather(batches: Iterator[pa.RecordBatch], kind: type) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    entities, chunks, seqs = [], [], []
    for b in batches:
        entities.append(b.column(0).to_numpy(zero_copy_only=False))
        chunks.append(b.column(1).to_numpy(zero_copy_only=False))
        seqs += [np.frombuffer(x, kind) for x in b.column(2).to_pylist()]
    if not seqs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    return np.concatenate(entities), np.concatenate(chunks), seqs


def frequent_subsequences(
    traces: DataFrame, share: float = 0.025, at_least: int = 10, shortest: int = 3, longest: int = 4, part_entities: int = PART_ENTITIES
) -> DataFrame:
    """``pattern`` (steps joined by `` > ``) and ``support`` of the patterns of ``shortest`` to ``longest`` steps, repeats
    allowed, that at least ``share`` of all entities (distinct ``func_id``, those without effects included) and at least
    ``at_least`` entities show, with any effects between the steps.

    Elements delivered twice under one ``seq`` count once, as do equal sequences of an entity. Null or empty effects
    support nothing; a null ``func_id`` is no entity. Sequences of any length are mined whole. An entity with very many
    sequences is cut into chunks over several parts; its patterns are then counted by entity, not by part. Empty
    tables and tables without frequent patterns give no rows.
    """
    spark = traces.sparkSession
    traces = traces.where(F.col("func_id").isNotNull())
    total = traces.select("func_id").distinct().count()
    least = max(at_least, math.ceil(share * total - 1e-9), 1)
    sequences = materialize(step_sequences(spread(traces.select("func_id", "effects"))), "steps")

    # An entity of at most L distinct steps adds L to all supports together, so at most L / share steps are frequent.
    shown = sequences.select("func_id", F.explode(F.array_distinct("steps")).alias("step")).distinct()
    steps = sorted(r.step for r in shown.groupBy("step").count().where(F.col("count") >= least).collect())
    empty = spark.createDataFrame([], "pattern string, support bigint")
    if not steps:
        return empty
    code_of = {s: i for i, s in enumerate(steps)}
    kind = np.uint16 if len(steps) <= SHORT_CODES else np.uint32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            codes = np.array([code_of.get(s, -1) for s in lists.flatten().to_pylist()], np.int32)
            ends = np.cumsum([0, *(len(x) for x in lists)])
            keep = [codes[i:j][codes[i:j] >= 0].astype(kind) for i, j in zip(ends, ends[1:])]
            long = [k for k, s in enumerate(keep) if len(s) >= shortest]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(long, pa.int64())), pa.array([keep[k].tobytes() for k in long], pa.binary())], ["func_id", "codes"])

    coded = sequences.select(F.col("func_id").cast("long").alias("func_id"), "steps").mapInArrow(encode, "func_id bigint, codes binary").distinct()
    coded = materialize(coded, "codes")
    per = coded.groupBy("func_id").count()
    chunks = per.where(F.col("count") > CHUNK).select("func_id", F.ceil(F.col("count") / CHUNK).cast("int").alias("_n"))
    size = per.agg(F.count("*"), F.coalesce(F.sum(F.ceil(F.col("count") / CHUNK)), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    entities = int(size[1])
    if not entities:
        return empty
    if entities > size[0]:
        chunk = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("codes"), F.col("_n")).cast("int") + 1).otherwise(0)
        coded = coded.join(chunks, "func_id", "left").select("func_id", chunk.alias("chunk"), "codes")
    else:
        coded = coded.select("func_id", F.lit(0).alias("chunk"), "codes")
    parts = max(-(-entities // part_entities), -(-int(size[2]) // PART_SEQUENCES))
    placed = coded.repartition(parts, "func_id", "chunk")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, chunk, seqs = _gather(batches, kind)
        if not seqs:
            return
        here = len(np.unique(np.stack([who, chunk]), axis=1).T)
        bound = max(1, math.ceil(least * here / entities - 1e-9)) if parts > 1 else least
        found = list(mine(Bitmaps(who, seqs), bound, shortest, longest))
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.array(p, kind).tobytes() for p, _ in found], pa.binary()), pa.array([len(w) for _, w in found], pa.int64())], ["codes", "n"]
        )

    mined = placed.mapInArrow(local, "codes binary, n bigint")
    if parts == 1:
        counted = mined.select("codes", F.col("n").alias("support"))
    else:
        # candidates reach their share in some part: as many as the parts' frequent patterns, whatever the corpus's size
        candidates = [tuple(np.frombuffer(r.codes, kind).tolist()) for r in mined.select("codes").distinct().toLocalIterator()]
        allowed = dict(_prefixes(candidates))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            who, chunk, seqs = _gather(batches, kind)
            if not seqs:
                return
            cut = np.unique(who[chunk > 0])
            out = {"codes": [], "n": [], "func_id": []}
            for p, w in mine(Bitmaps(who, seqs), 1, shortest, longest, allowed):
                code, shared = np.array(p, kind).tobytes(), np.intersect1d(w, cut)
                for n, f in [(len(w) - len(shared), None), *((0, int(f)) for f in shared)]:
                    out["codes"].append(code)
                    out["n"].append(n)
                    out["func_id"].append(f)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("codes", pa.binary()), ("n", pa.int64()), ("func_id", pa.int64())]))

        every = placed.mapInArrow(count, "codes binary, n bigint, func_id bigint")
        by = every.groupBy("codes", "func_id").agg(F.sum("n").alias("n"))
        counted = by.groupBy("codes").agg((F.sum("n") + F.count("func_id")).alias("support"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [SEPARATOR.join(steps[k] for k in np.frombuffer(c, kind)) for c in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), b.column(1)], ["pattern", "support"])

    return counted.where(F.col("support") >= least).mapInArrow(names, "pattern string, support bigint")
