"""Most similar vectors for every vector (problem 3): balanced posting lists with an in-memory centroid graph.

Index: a bounded sample of the distinct signatures serves as centroids, joined into a nearest-neighbour graph that every
worker holds. Each distinct signature is stored in the lists of its nearest centroids, found by a best-first walk over
the graph; boundary signatures fall into several lists. With the distance taken as slots by agreeing slots, a list is
kept while its distance is at most ``RATIO`` times the nearest one, up to ``LISTS``.

Balance: a centroid in the middle of a dense family draws all of it into one list. List lengths are estimated before
anything is shuffled; a long list is cut into blocks, and each pair of blocks is a unit of work of its own, so no task
holds more than two blocks. Inside a unit every row keeps a running list of its k best, so memory doesn't grow with the
number of similar pairs.

Signatures travel as 24 bits of every slot. Two different slot values agree in them once in 16.7 million, so an
agreement is overstated for about 2 pairs in a million. ``exact_neighbours`` compares whole signatures, for a stated query
set against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.near_duplicates import SLOTS, eligible, with_digest
from traceloom.operators.blocks import Best, agreement, nearest_in_blocks
from traceloom.operators.shared import materialize, spread

#: Bound of the sample that the index is fitted on; reached at 3 million distinct signatures.
CENTROIDS = 65_536
PER_CENTROID = 48
DEGREE = 24
PIVOTS = 384
SEED_SLOTS = 3
LISTS = 5
RATIO = 2.0
BEAM = 32
#: Rows of a block; longer lists are cut. Lengths are estimated from one distinct signature in LENGTH_SAMPLE.
BLOCK = 4096
LENGTH_SAMPLE = 16
#: Tasks for units of long lists, beside the usual ones.
MOST_TASKS = 20_000
BYTES = 3 * SLOTS


# ---- codes -----------------------------------------------------------------------------------------------------------


def code_slots(sigs: np.ndarray) -> np.ndarray:
    """24 bits of every slot of (n, 128) signatures, as bytes in three planes of 128."""
    x = sigs.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return np.concatenate([((x >> np.uint64(s)) & np.uint64(255)).astype(np.uint8) for s in (8, 16, 24)], axis=1)


def _full(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Agreeing slots by all three planes, row against row."""
    same = a == b
    return (same[:, :SLOTS] & same[:, SLOTS : 2 * SLOTS] & same[:, 2 * SLOTS :]).sum(axis=1)


# ---- centroid graph --------------------------------------------------------------------------------------------------


class Graph:
    """Centroids (one plane of bytes), their nearest-neighbour graph and the places where a walk may start.

    A walk starts from the best of a fixed set of pivots and from one centroid for each run of three slots that it has
    in common with the query.
    """

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE, pivots: int = PIVOTS):
        self.c = np.ascontiguousarray(centroids[:, :SLOTS])
        n = len(self.c)
        self.pivots = np.arange(min(n, pivots))  # the sample is in random order
        self.flat = n <= pivots
        if not self.flat:
            self.links = self._nearest(min(degree, n - 1))
            keys = self._runs(self.c)
            self.order = np.argsort(keys, axis=0, kind="stable").astype(np.int32)
            self.keys = np.take_along_axis(keys, self.order, 0)

    @staticmethod
    def _runs(c: np.ndarray) -> np.ndarray:
        runs = c[:, : SLOTS // SEED_SLOTS * SEED_SLOTS].reshape(len(c), -1, SEED_SLOTS).astype(np.int32)
        return runs[:, :, 0] | runs[:, :, 1] << 8 | runs[:, :, 2] << 16

    def _seeds(self, q: np.ndarray) -> np.ndarray:
        """A centroid that shares the run of slots, per query and run; -1 where none does."""
        wanted, out = self._runs(q), np.full((len(q), self.keys.shape[1]), -1)
        for r in range(out.shape[1]):
            at = np.minimum(np.searchsorted(self.keys[:, r], wanted[:, r]), len(self.c) - 1)
            hit = self.keys[at, r] == wanted[:, r]
            out[hit, r] = self.order[at[hit], r]
        return out

    def _nearest(self, degree: int) -> np.ndarray:
        """Approximately nearest centroids of each: sign projections of the slots turn agreement into a dot product."""
        x = self.c.astype(np.uint32)
        x = (x + np.uint32(257) * np.arange(SLOTS, dtype=np.uint32)) * np.uint32(2654435761)
        x ^= x >> np.uint32(15)
        signs = np.concatenate([((x >> np.uint32(s)) & np.uint32(1)).astype(np.float32) * 2 - 1 for s in (3, 7, 12)], axis=1)
        out = np.empty((len(x), degree), np.int32)
        for i in range(0, len(x), 256):
            dots = signs[i : i + 256] @ signs.T
            dots[np.arange(len(dots)), np.arange(i, i + len(dots))] = -np.inf
            out[i : i + 256] = np.argpartition(-dots, degree - 1, axis=1)[:, :degree]
        return out

    def nearest(self, queries: np.ndarray, k: int, rounds: int = 6, width: int = 4, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``k`` nearest centroids of each query (numbers, agreeing slots), nearest first; -1 where there are fewer."""
        found = [self._walk(queries[i : i + block, :SLOTS], k, rounds, width) for i in range(0, len(queries), block)]
        if not found:
            return np.zeros((0, k), np.int64), np.zeros((0, k), np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _walk(self, q: np.ndarray, k: int, rounds: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(q), len(self.c)
        beam = max(BEAM, k)
        # a place in the pool is agreement * size + (size - 1 - centroid): higher agreement first, then the smaller number
        scores = agreement(q[:, None, :], self.c[self.pivots][None, :, :]).astype(np.int64)
        pool = scores * size + (size - 1 - self.pivots)
        if not self.flat:
            seeds = self._seeds(q)
            score = agreement(q[:, None, :], self.c[seeds]).astype(np.int64)
            pool = np.concatenate([pool, np.where(seeds >= 0, score * size + (size - 1 - seeds), -1)], axis=1)
        pool = -np.sort(-pool, axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        pool = -np.sort(-pool, axis=1)[:, :beam]
        if not self.flat:
            open_ = np.ones(pool.shape, bool)
            for _ in range(rounds):
                first = np.argsort(~open_, axis=1, kind="stable")[:, :width]
                todo = np.take_along_axis(open_, first, 1) & (np.take_along_axis(pool, first, 1) >= 0)
                if not todo.any():
                    break
                at = size - 1 - np.take_along_axis(pool, first, 1) % size
                np.put_along_axis(open_, first, False, 1)
                near = self.links[at].reshape(n, -1)
                score = agreement(q[:, None, :], self.c[near]).astype(np.int64)
                new = score * size + (size - 1 - near)
                both = np.concatenate([pool * 2, new * 2 + 1], axis=1)  # a known place sorts just after its new copy
                opened = np.concatenate([open_, np.ones(new.shape, bool)], axis=1)
                order = np.argsort(-both, axis=1)
                both, opened = np.take_along_axis(both, order, 1), np.take_along_axis(opened, order, 1)
                # of equal places one stays, closed if any of them is
                for _ in range(2):
                    twin = both[:, 1:] >> 1 == both[:, :-1] >> 1
                    opened[:, :-1] &= ~twin | opened[:, 1:]
                    opened[:, 1:] &= ~twin | opened[:, :-1]
                first_of = np.concatenate([np.ones((n, 1), bool), both[:, 1:] >> 1 != both[:, :-1] >> 1], axis=1)
                keep = np.argsort(~first_of, axis=1, kind="stable")[:, :beam]
                kept = np.take_along_axis(first_of, keep, 1)
                pool = np.where(kept, np.take_along_axis(both, keep, 1) >> 1, -1)
                open_ = np.take_along_axis(opened, keep, 1) & kept
        pool = pool[:, :k]
        number = np.where(pool >= 0, size - 1 - pool % size, -1)
        score = np.where(pool >= 0, pool // size, -1)
        if pool.shape[1] < k:
            pad = ((0, 0), (0, k - pool.shape[1]))
            number, score = np.pad(number, pad, constant_values=-1), np.pad(score, pad, constant_values=-1)
        return number, score


def chosen_lists(graph: Graph, codes: np.ndarray, lists: int = LISTS, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for every list that a row is stored in, by distance ratio; the nearest list always."""
    number, score = graph.nearest(codes, lists)
    # distance = 128 / agreement; no agreement at all counts as half a slot
    distance = SLOTS / np.maximum(score, 0.5)
    keep = (number >= 0) & (distance <= ratio * distance[:, :1])
    row, place = np.nonzero(keep)
    return row, number[row, place]


# ---- search inside a list --------------------------------------------------------------------------------------------


def best_partners(codes: np.ndarray, ids: np.ndarray, least: int, k: int, split: int | None = None, rows: int = 128, cols: int = 512) -> np.ndarray:
    """(x, y, agreement): for each row its up to ``k`` best partners that agree in at least ``least`` slots.

    With ``split`` only pairs of a row before and a row after that place count. Tiles are compared by one byte per slot,
    which never understates; what could enter a row's best is then compared by all three.
    """
    first = np.argsort(ids[: split or len(ids)], kind="stable")  # ties are settled early in the order of ids
    order = first if split is None else np.append(first, split + np.argsort(ids[split:], kind="stable"))
    codes, ids = codes[order], ids[order]
    plane, best = np.ascontiguousarray(codes[:, :SLOTS]), Best(len(ids), k)
    for i in range(0, split or len(ids), rows):
        across = slice(i, min(i + rows, split or len(ids)))
        for j in range(i if split is None else split, len(ids), cols):
            down = slice(j, min(j + cols, len(ids)))
            score = agreement(plane[across, None, :], plane[None, down, :])
            hit = score >= least
            if not hit.any():
                continue
            hit &= best.may_enter(across, score, ids[down]) | best.may_enter(down, score.T, ids[across]).T
            a, b = np.nonzero(hit)
            a, b = a + across.start, b + down.start
            if split is None:
                a, b = a[a < b], b[a < b]
            s = _full(codes[a], codes[b])
            a, b, s = a[s >= least], b[s >= least], s[s >= least]
            best.add(a, ids[b], s)
            best.add(b, ids[a], s)
    return best.found(ids)


# ---- on Spark --------------------------------------------------------------------------------------------------------


def _coded(funcs: DataFrame) -> DataFrame:
    rows = with_digest(spread(eligible(funcs).select(F.col("id").cast("long").alias("id"), "sig"))).select("h1", "h2", "id", "sig")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False)
            codes = code_slots(np.ascontiguousarray(flat.reshape(-1, SLOTS)))
            blob = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer((np.arange(len(codes) + 1) * BYTES).astype(np.int32)), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), blob], ["h1", "h2", "id", "code"])

    return rows.mapInArrow(code, "h1 bigint, h2 bigint, id bigint, code binary")


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)


def _sample(coded: DataFrame, most: int) -> np.ndarray:
    """Centroids: distinct signatures with a small digest, about one in ``PER_CENTROID`` and at most ``most``."""
    n = coded.agg(F.approx_count_distinct("h1")).first()[0]
    want = min(most, max(1, n // PER_CENTROID))
    bar = min(1.0, 1.3 * want / max(1, n) + 64 / max(1, n))
    below = F.pmod(F.xxhash64("h2"), F.lit(1 << 40)) < int(bar * (1 << 40))
    got = coded.where(below).select("h1", "h2", "code").dropDuplicates(["h1", "h2"]).orderBy("h2", "h1").limit(want).toArrow()
    codes = _codes(got.column("code").combine_chunks()) if len(got) else np.zeros((0, BYTES), np.uint8)
    return codes[np.random.default_rng(0).permutation(len(codes))]


def _blocks(classes: DataFrame, graph: Broadcast, lists: int, ratio: float) -> np.ndarray:
    """Number of blocks of every list, from the lists of a sample of the distinct signatures: one number per centroid."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, own = chosen_lists(graph.value, _codes(b.column(0)), lists, ratio)
                lists_, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lists_, pa.int32()), pa.array(n, pa.int64())], ["list", "n"])

    sample = classes.where(F.pmod("h2", F.lit(LENGTH_SAMPLE)) == 0).select("code")
    counted = sample.mapInArrow(lengths, "list int, n bigint").groupBy("list").agg(F.sum("n").alias("n")).where(F.col("n") * LENGTH_SAMPLE > BLOCK)
    found, out = counted.toArrow(), np.ones(len(graph.value.c), np.int64)
    out[found.column("list").to_numpy()] = -(-found.column("n").to_numpy() * LENGTH_SAMPLE // BLOCK)
    return out


def similar_classes(classes: DataFrame, centroids: np.ndarray, least: int, k: int, lists: int = LISTS, ratio: float = RATIO) -> DataFrame:
    """``x``, ``y``, ``agree``: for each class (``rep``, ``h2``, ``code``) its up to ``k`` best other classes, each found once."""
    held = classes.sparkSession.sparkContext.broadcast(Graph(centroids))
    blocks = _blocks(classes, held, lists, ratio)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, own = chosen_lists(held.value, _codes(b.column(1)), lists, ratio)
                many = blocks[own]
                # a row of a list of n blocks goes to each of its block's n units; unit (lo, hi) has the number lo * n + hi
                mine = (b.column(0).to_numpy()[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many
                at = np.repeat(np.arange(len(row)), many)
                other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                unit = np.minimum(mine[at], other) * many[at] + np.maximum(mine[at], other)
                for i in range(0, len(at), 20_000):
                    part = slice(i, i + 20_000)
                    take = pa.array(row[at[part]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[at[part]], pa.int32()), pa.array(unit[part], pa.int32()), pa.array(mine[at[part]], pa.int32()), b.column(0).take(take), b.column(1).take(take)],
                        ["list", "unit", "block", "rep", "code"],
                    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def partners(parts: list[pa.RecordBatch]) -> np.ndarray:
            block, reps = (np.concatenate([p.column(n).to_numpy() for p in parts]) for n in (2, 3))
            codes = np.concatenate([_codes(p.column(4)) for p in parts])
            lo, hi = divmod(int(parts[0].column(1)[0].as_py()), int(blocks[parts[0].column(0)[0].as_py()]))
            split = int(np.searchsorted(block, hi)) if lo != hi else None
            return best_partners(codes, reps, least, k, split)

        def out(found: list[np.ndarray]) -> pa.RecordBatch:
            x, y, s = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(s, pa.int32())], ["x", "y", "agree"])

        held_parts, at, found = [], None, []
        for b in batches:
            own = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            cut = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own)) if len(own) else []
            for i, j in zip(cut, cut[1:]):
                if own[i] != at and held_parts:
                    found.append(partners(held_parts))
                    held_parts = []
                at = own[i]
                held_parts.append(b.slice(i, j - i))
            yield out(found)
            found = []
        if held_parts:
            yield out([partners(held_parts)])

    stored = classes.select("rep", "code").mapInArrow(store, "list int, unit int, block int, rep bigint, code binary")
    # units cost far more than their bytes tell, so their number of tasks is set, not left to the sizes
    units = int((blocks * (blocks + 1) // 2)[blocks > 1].sum())
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")) + min(units, MOST_TASKS)
    by_list = stored.repartition(tasks, "list", "unit").sortWithinPartitions("list", "unit", "block")
    found = by_list.mapInArrow(search, "x bigint, y bigint, agree int")
    best = Window.partitionBy("x").orderBy(F.col("agree").desc(), "y")
    ranked = found.withColumn("_r", F.dense_rank().over(best)).where(F.col("_r") <= k)
    return ranked.groupBy("x", "y").agg(F.max("agree").alias("agree"))


def nearest_rows(funcs: DataFrame, k: int = 5, least: int = 90, lists: int = LISTS, ratio: float = RATIO, most: int = CENTROIDS) -> DataFrame:
    """``id``, ``neighbour_id``, ``agree``: for every eligible row the up to ``k`` other eligible rows that agree with it
    in the most slots, at least ``least``, smaller ``neighbour_id`` first among ties.

    Rows of equal signature are one class in the search and neighbours with 128 agreeing slots; of each class only its
    ``k + 1`` smallest ids can be anyone's neighbours, so a class of any size stays small on the way. Different classes
    are found with the recall of the index (see ``recall`` and the README). Ineligible rows (null fields, other
    lengths, null slots) take no part; rows without a neighbour give no row; a row delivered twice under one id is one
    neighbour and gives its rows twice; an empty table gives none.
    """
    coded = materialize(_coded(funcs), "codes")
    by_id = Window.partitionBy("h1", "h2").orderBy("id")
    firsts = coded.select("h1", "h2", "id").withColumn("_r", F.dense_rank().over(by_id)).where(F.col("_r") <= k + 1)
    firsts = firsts.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("rep", F.get("ids", F.lit(0)))
    classes = coded.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.any_value("code").alias("code")).select("h2", "rep", "code")
    edges = similar_classes(classes, _sample(coded, most), least, k, lists, ratio)
    own = firsts.select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(SLOTS).alias("agree"))
    near = edges.unionByName(own).join(firsts.select(F.col("rep").alias("y"), "ids"), "y").select("x", "agree", F.explode("ids").alias("n"))
    best = Window.partitionBy("x").orderBy(F.col("agree").desc(), "n")
    near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    tops = near.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("_r", "n", "agree"))).alias("top"))
    whole = firsts.select("h1", "h2", F.col("rep").alias("x")).join(tops, "x")
    rows = coded.select("h1", "h2", "id").join(whole.select("h1", "h2", "top"), ["h1", "h2"])
    others = F.slice(F.filter("top", lambda t: t["n"] != F.col("id")), 1, k)
    return rows.select("id", F.inline(F.transform(others, lambda t: F.struct(t["n"].alias("neighbour_id"), t["agree"].alias("agree")))))


def exact_neighbours(funcs: DataFrame, asked: Column, k: int = 5, least: int = 90) -> DataFrame:
    """``id``, ``neighbour_id``, ``agree`` as ``nearest_rows`` defines them, for the eligible rows for which ``asked`` holds, by
    comparing their whole signatures with those of all eligible rows, in blocks.

    The exact way, and the measure of the index: the work is queries times rows, so it is meant for a stated query set.
    Repeated ids are one neighbour and one query.
    """
    rows = eligible(funcs).select(F.col("id").cast("long").alias("place"), "sig")
    queries = rows.where(asked).select(F.col("place").alias("q"), "sig").dropDuplicates(["q"])
    # the rows are a filtered table: reading them again costs less than storing them
    found = nearest_in_blocks(queries, rows, k + 1, least, stored=True).where("q <> place")
    best = Window.partitionBy("q").orderBy(F.col("equal").desc(), "place")
    ranked = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    return ranked.select(F.col("q").alias("id"), F.col("place").alias("neighbour_id"), F.col("equal").cast("int").alias("agree"))


def recall(funcs: DataFrame, every: int = 100, k: int = 5, least: int = 90, enough: float = 0.9) -> DataFrame:
    """One row: how much of the exact result for the ids divisible by ``every`` the index gives: ``queries`` (with a
    neighbour), ``wanted`` pairs, ``recall`` and ``enough`` (whether it reaches that share)."""
    test = F.pmod("place", F.lit(every)) == 0
    exact = exact_neighbours(funcs, test, k, least).select("id", "neighbour_id")
    got = nearest_rows(funcs, k, least).select("id", "neighbour_id").where(F.pmod("id", F.lit(every)) == 0).withColumn("_got", F.lit(1))
    both = exact.join(got.distinct(), ["id", "neighbour_id"], "left")
    share = F.coalesce(F.try_divide(F.count("_got"), F.count("id")), F.lit(1.0))
    return both.agg(F.count_distinct("id").alias("queries"), F.count("id").alias("wanted"), share.alias("recall"), (share >= enough).alias("enough"))
