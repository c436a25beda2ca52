"""A query set against all rows, in blocks: exact ranks and best matches without making pairs.

Queries are dealt into blocks that fit a worker, rows into shares; every (block, share) is one group of a single shuffle.
A worker holds the block's signatures and streams the share past them, so what leaves it is a bounded record per query
and share, never a pair. Up to ``BLOCK`` queries no row is sent twice; beyond that each further block costs one more pass of
the rows. Signatures are compared by 16 bits of every slot first, which never understates, and whole only where that could
change a figure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.operators.shared import materialize

BLOCK = 16_384
SHARE = 32_768
LEAST_SHARE = 1024
_TILE, _ROWS, _PAIRS = 64, 512, 16_384
_FAR = np.iinfo(np.int64).max


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Agreeing slots along the last axis (128 slots)."""
    bits = np.packbits(a == b, axis=-1)
    return np.bitwise_count(bits.view(np.uint64)).sum(axis=-1, dtype=np.int16)


def _thin(sigs: np.ndarray) -> np.ndarray:
    """16 bits of every slot."""
    x = np.ascontiguousarray(sigs).view(np.uint64)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(C.GOLDEN) >> np.uint64(48)).astype(np.uint16)


def _whole(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Agreeing slots of the rows ``at`` of a and ``to`` of b, some pairs at a time."""
    parts = [(a[at[i : i + _PAIRS]] == b[to[i : i + _PAIRS]]).sum(axis=1) for i in range(0, len(at), _PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Best:
    """The ``k`` best partners of each of ``n`` rows so far, best first: more agreeing slots, then the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -1, np.int16)
        self.who = np.full((n, k), _FAR)

    def may_enter(self, rows: slice, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of the partners ``ids`` (columns) would be among the best of ``rows`` with these scores."""
        last, who = self.score[rows, -1:], self.who[rows, -1:]
        return (score > last) | ((score == last) & (ids[None, :] < who))

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(row):
            return
        k = self.score.shape[1]
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(starts, len(row)))
        rank = np.arange(len(row)) - np.repeat(starts, size)
        keep = rank < k
        rows = row[starts]
        new_score, new_who = np.full((len(rows), k), -1, np.int16), np.full((len(rows), k), _FAR)
        at = np.repeat(np.arange(len(rows)), size)[keep]
        new_score[at, rank[keep]], new_who[at, rank[keep]] = score[keep], ids[keep]
        both, who = np.concatenate([self.score[rows], new_score], axis=1), np.concatenate([self.who[rows], new_who], axis=1)
        first = np.lexsort((who, -both), axis=1)[:, :k]
        self.score[rows], self.who[rows] = np.take_along_axis(both, first, 1), np.take_along_axis(who, first, 1)

    def found(self, ids: np.ndarray) -> np.ndarray:
        """(x, y, agreement) of all rows."""
        row, place = np.nonzero(self.score >= 0)
        return np.stack([ids[row], self.who[row, place], self.score[row, place].astype(np.int64)])


class _Tops:
    """The k best rows of each query of a block."""

    def __init__(self, q: np.ndarray, sigs: np.ndarray, k: int, least: int):
        self.q, self.sigs, self.thin, self.least, self.best = q, sigs, _thin(sigs), least, Best(len(q), k)
        self.last: int | None = None

    def see(self, place: np.ndarray, sigs: np.ndarray, *_: np.ndarray) -> None:
        # rows of a share come in the order of their places, so one that was delivered twice follows itself
        fresh = np.concatenate([[place[0] != self.last], place[1:] != place[:-1]])
        self.last = int(place[-1])
        place, sigs = place[fresh], sigs[fresh]
        thin = _thin(sigs)
        for i in range(0, len(self.q), _TILE):
            s = slice(i, i + _TILE)
            rough = agreement(self.thin[s, None, :], thin[None, :, :])
            a, b = np.nonzero((rough >= self.least) & self.best.may_enter(s, rough, place))
            equal = _whole(self.sigs, a + i, sigs, b)
            ok = equal >= self.least
            self.best.add(a[ok] + i, place[b[ok]], equal[ok])

    def out(self) -> list[np.ndarray]:
        return list(self.best.found(self.q))


class _Tagged:
    """The best row with the same tag for each query of a block; rows of other tags aren't compared."""

    def __init__(self, q: np.ndarray, sigs: np.ndarray, tag: np.ndarray):
        self.q, self.sigs, self.tag, self.best = q, sigs, tag, Best(len(q), 1)

    def see(self, place: np.ndarray, sigs: np.ndarray, tag: np.ndarray) -> None:
        for i in range(0, len(self.q), _TILE):
            a, b = np.nonzero(self.tag[i : i + _TILE, None] == tag[None, :])
            self.best.add(a + i, place[b], _whole(self.sigs, a + i, sigs, b))

    def out(self) -> list[np.ndarray]:
        seen = self.best.score[:, 0] >= 0
        return [x[seen] for x in (self.q, self.tag, self.best.who[:, 0], self.best.score[:, 0].astype(np.int64))]


class _Ranks:
    """Per query of a block: how many rows are ahead of a bar, and the best row."""

    def __init__(self, q: np.ndarray, sigs: np.ndarray, bar: np.ndarray, bar_place: np.ndarray):
        self.q, self.sigs, self.thin, self.bar, self.bar_place = q, sigs, _thin(sigs), bar, bar_place
        self.ahead, self.best = np.zeros(len(q), np.int64), Best(len(q), 1)

    def see(self, place: np.ndarray, sigs: np.ndarray, *_: np.ndarray) -> None:
        thin = _thin(sigs)
        for i in range(0, len(self.q), _TILE):
            s = slice(i, i + _TILE)
            rough = agreement(self.thin[s, None, :], thin[None, :, :])
            a, b = np.nonzero((rough >= self.bar[s, None]) | self.best.may_enter(s, rough, place))
            a += i
            equal = _whole(self.sigs, a, sigs, b)
            over = (equal > self.bar[a]) | ((equal == self.bar[a]) & (place[b] < self.bar_place[a]))
            self.ahead += np.bincount(a[over], minlength=len(self.q))
            self.best.add(a, place[b], equal)

    def out(self) -> list[np.ndarray]:
        seen = self.best.score[:, 0] >= 0
        return [x[seen] for x in (self.q, self.ahead, self.best.score[:, 0].astype(np.int64), self.best.who[:, 0])]


def _through(queries: DataFrame, rows: DataFrame, extra: tuple[str, ...], make: Callable, names: list[str], block: int, share: int, stored: bool, asked: int | None = None) -> DataFrame:
    """Groups of a block of queries (``q, sig, *extra``) and a share of rows (``place, sig``), each seen by what ``make`` gives. Rows
    have those of the extra columns that they share with the queries."""
    shared = [c for c in extra if c in rows.columns]
    queries = queries.select(F.col("q").cast("long").alias("q"), "sig", *(F.col(c).cast("long").alias(c) for c in extra))
    if asked is None:
        queries = materialize(queries, "queries")
    rows = rows.select(F.col("place").cast("long").alias("place"), "sig", *(F.col(c).cast("long").alias(c) for c in shared))
    rows = rows if stored else materialize(rows, "rows")
    blocks, n = max(1, -(-(queries.count() if asked is None else asked) // block)), rows.count()
    # small inputs are dealt to all cores
    shares = max(1, -(-n // share), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_SHARE)))
    number = lambda c, m: F.pmod(F.xxhash64(c, *shared), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = queries.select(number("q", blocks).alias("b"), every(shares).alias("s"), F.lit(0).alias("kind"), F.col("q").alias("n"), "sig", *extra)
    none = [F.col(c) if c in shared else F.lit(0).cast("long").alias(c) for c in extra]
    r = rows.select(every(blocks).alias("b"), number("place", shares).alias("s"), F.lit(1).alias("kind"), F.col("place").alias("n"), "sig", *none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, state = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in state.out()], names)

        for batch in batches:
            b, s, kind, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            sigs = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, C.SLOTS)
            others = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5, batch.num_columns)]
            new = np.concatenate([[True], (b[1:] != b[:-1]) | (s[1:] != s[:-1]) | (kind[1:] != kind[:-1])]) if len(b) else np.zeros(0, bool)
            cut = np.append(np.flatnonzero(new), len(b))
            for i, j in zip(cut, cut[1:]):
                group = (int(b[i]), int(s[i]))
                if group != at:
                    yield from done()
                    at, held, state = group, [], None
                if kind[i] == 0:
                    held.append((n[i:j], sigs[i:j], *(x[i:j] for x in others)))
                elif held or state:
                    if state is None:
                        state, held = make(*(np.concatenate(x) for x in zip(*held))), []
                    for k in range(i, j, _ROWS):
                        part = slice(k, min(j, k + _ROWS))
                        state.see(n[part], sigs[part], *(x[part] for x in others))
        yield from done()

    dealt = q.unionByName(r).repartition("b", "s").sortWithinPartitions("b", "s", "kind", "n")
    return dealt.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def against_all(queries: DataFrame, rows: DataFrame, block: int = BLOCK, share: int = SHARE, stored: bool = False, asked: int | None = None) -> DataFrame:
    """``q, ahead, top_equal, top_place`` of every query, compared with all rows by agreeing slots.

    ``queries`` has ``q, sig, bar, bar_place``: ``ahead`` counts the rows that agree in more than ``bar`` slots, or in as many
    with a smaller ``place`` than ``bar_place``. ``rows`` has ``place, sig``; the best row has the most agreeing slots and, of
    equals, the smallest place. All signatures have 128 slots without nulls; no rows, or no queries, give no result.
    Both inputs are stored and counted when the plan is built; ``stored`` tells that the rows already are, ``asked`` that the
    queries are, and how many there are.
    """
    partial = _through(queries, rows, ("bar", "bar_place"), _Ranks, ["q", "ahead", "top_equal", "top_place"], block, share, stored, asked)
    best = F.min(F.struct((-F.col("top_equal")).alias("e"), F.col("top_place").alias("p"))).alias("_t")
    summed = partial.groupBy("q").agg(F.sum("ahead").alias("ahead"), best)
    return summed.select("q", "ahead", (-F.col("_t.e")).alias("top_equal"), F.col("_t.p").alias("top_place"))


def nearest_in_blocks(queries: DataFrame, rows: DataFrame, k: int, least: int = 0, block: int = BLOCK, share: int = SHARE, stored: bool = False) -> DataFrame:
    """``q, place, equal``: for each query (``q, sig``) the ``k`` best rows (``place, sig``) of every share, so the k best of all
    are among them: at least ``least`` agreeing slots, more first, then the smaller place. A place that is delivered twice is
    one row. Null-free signatures of 128 slots;
    empty sides give no rows. Both inputs are stored and counted when the plan is built; ``stored`` tells that the rows already are."""
    return _through(queries, rows, (), lambda q, sigs: _Tops(q, sigs, k, least), ["q", "place", "equal"], block, share, stored)


def best_with_tag(queries: DataFrame, rows: DataFrame, block: int = BLOCK, share: int = SHARE, stored: bool = False) -> DataFrame:
    """``q, tag, place, equal``: for each query (``q, sig, tag``) the row (``place, sig, tag``) of its own tag with the most agreeing
    slots and, of equals, the smallest place. Ids may come with several tags. A tag that very many queries and rows share
    is dealt like all others, so its pairs are compared in many tasks and never leave them; a query whose tag no row has
    gives no row."""
    partial = _through(queries, rows, ("tag",), _Tagged, ["q", "tag", "place", "equal"], block, share, stored)
    best = F.min(F.struct((-F.col("equal")).alias("e"), F.col("place").alias("p"))).alias("_t")
    return partial.groupBy("q", "tag").agg(best).select("q", "tag", F.col("_t.p").alias("place"), (-F.col("_t.e")).alias("equal"))
