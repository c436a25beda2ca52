"""Filling fixed-capacity containers (problem 8): optimal length buckets and token-budget batches.

1. One pass sizes every text; the sizes are written to the shared folder, since two later steps read them.
2. A dynamic program over the global histogram of sizes (at most one entry per size up to the capacity, whatever the data)
   chooses the bucket boundaries that minimise padding.
3. Batches are planned on the bucket counts alone: a batch opens in the bucket of the largest items left, takes as many
   of that bucket as its token budget allows and, with ``top_up``, spends what remains of the budget on the largest
   items of shorter buckets that fit. Equal batches are planned once with their number, so the plan stays small.
4. Every item finds its batch from its bucket and its rank in the bucket. Ranks come from counts by (bucket, part) and
   row numbers inside a part, so no bucket is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.tokenize import count_tokens
from traceloom.operators.numbering import constants
from traceloom.operators.shared import materialize

BUCKETS = 256
PART_ITEMS = 200_000


def _halvings(n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All of range(n) in rounds of midpoints, each with the nearest places before and after it that came earlier."""
    rounds, spans = [], [(-1, n)]
    while spans := [(a, b) for a, b in spans if b - a > 1]:
        mids = [(a + b) // 2 for a, b in spans]
        rounds.append((np.array(mids), np.array([a for a, _ in spans]), np.array([b for _, b in spans])))
        spans = [x for (a, b), m in zip(spans, mids) for x in ((a, m), (m, b))]
    return rounds


def length_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets that minimise the padding of every item to its bucket's bound.

    Dynamic program over the number of buckets. The best start of the last bucket never moves back as the end moves on,
    so each round of midpoints only searches between the starts of its neighbours.
    """
    n = len(lengths)
    if n <= buckets:
        return lengths.copy()
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    mass = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)
    best = lengths * total[1:] - mass[1:]
    cuts, rounds = [np.zeros(n, np.int64)], _halvings(n)
    for _ in range(1, buckets):
        before = np.concatenate([[0], best[:-1]])  # padding of what lies before a start
        now, cut = best.copy(), np.zeros(n, np.int64)
        for mid, left, right in rounds:
            low = np.where(left >= 0, cut[np.maximum(left, 0)], 0)
            high = np.minimum(np.where(right < n, cut[np.minimum(right, n - 1)], n - 1), mid)
            size = high - low + 1
            first = np.cumsum(size) - size
            start = np.arange(size.sum()) - np.repeat(first - low, size)
            end = np.repeat(mid, size)
            cost = before[start] + lengths[end] * (total[end + 1] - total[start]) - (mass[end + 1] - mass[start])
            least = np.minimum.reduceat(cost, first)
            now[mid] = least
            cut[mid] = np.minimum.reduceat(np.where(cost == np.repeat(least, size), start, n), first)
        best = now
        cuts.append(cut)
    bounds, j = [], n - 1
    for cut in reversed(cuts):
        if j < 0:
            break
        bounds.append(lengths[j])
        j = int(cut[j]) - 1
    return np.array(bounds[::-1])


@dataclass(frozen=True)
class Plan:
    """Runs of equal batches: items of ``bucket`` ranked from ``start`` on go ``each`` to a container, from ``base`` on."""

    bucket: np.ndarray
    start: np.ndarray
    each: np.ndarray
    base: np.ndarray
    containers: int


def plan_batches(bounds: np.ndarray, counts: np.ndarray, capacity: int, top_up: bool = True) -> Plan:
    """Token-budget batches over bucket counts. Every round uses up at least one bucket, so runs are at most a few per bucket."""
    left, used, rows, base = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), [], 0
    for k in range(len(bounds) - 1, -1, -1):
        while left[k] > 0:
            budget, take = capacity, {}
            j = k
            while j >= 0:
                m = int(min(left[j], budget // bounds[j])) if (top_up or j == k) else 0
                if m > 0:
                    take[j] = m
                    budget -= m * int(bounds[j])
                j -= 1
            times = min(int(left[j]) // m for j, m in take.items())
            for j, m in take.items():
                rows.append((j, used[j], m, base))
                used[j] += m * times
                left[j] -= m * times
            base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return Plan(*cols, base)


def pieces(sizes: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Items from sized texts: a text within the capacity is one item, a larger one is cut into full pieces and a rest."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"int((n_tokens - 1) div {capacity})"))))
    cut = sizes.select(id_col, "n_tokens", at.alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select(id_col, "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(capacity)).alias("size"))


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", buckets: int = BUCKETS, top_up: bool = True) -> DataFrame:
    """Containers for sized texts (``id_col``, ``n_tokens``); ``sizes`` should be a stored table, as two passes read it.

    Returns one row per item: ``id_col``, ``piece`` (0 for uncut texts), ``start`` (first token), ``size`` (tokens),
    ``bucket`` (the bound it was planned with) and ``container``. A container's sizes add up to at most the capacity.
    ``top_up=False`` keeps to the method in the strict sense: batches are formed inside one bucket only. With ``top_up`` a
    batch that was opened in one bucket may spend the rest of its budget on items of shorter buckets.
    Texts of no tokens take no space: they are spread evenly over the containers, or share container 0 if there is no
    other. A null size counts as 0. Equal texts and repeated ids are items of their own. Empty input gives no rows.
    """
    spark = sizes.sparkSession
    sizes = sizes.select(id_col, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    items = pieces(sizes, capacity, id_col)

    # at most one row per size up to the capacity reaches the driver, whatever the corpus
    hist = dict(items.groupBy(F.col("size").cast("int")).count().toLocalIterator(prefetchPartitions=True))
    lengths = np.array(sorted(x for x in hist if x > 0), np.int64)
    counts = np.array([hist[x] for x in lengths.tolist()], np.int64)
    bounds = length_buckets(lengths, counts, buckets) if len(lengths) else np.zeros(0, np.int64)
    of_level = np.searchsorted(bounds, lengths)
    in_bucket = np.bincount(of_level, counts, len(bounds)).astype(np.int64)
    plan = plan_batches(bounds, in_bucket, capacity, top_up)

    total = sum(hist.values())
    parts = max(1, -(-total // PART_ITEMS))
    bound_of = constants([0, *bounds.tolist()], "int")
    bucket_no = constants([0, *(np.searchsorted(bounds, np.arange(1, capacity + 1)) + 1).tolist()] if len(bounds) else [0], "int")
    tagged = items.withColumns(
        {
            "_b": F.coalesce(F.get(bucket_no, F.col("size").cast("int")), F.lit(0)),
            "_p": F.pmod(F.xxhash64(id_col, "piece"), F.lit(parts)).cast("int"),
        }
    )
    sums = tagged.groupBy("_b", "_p").count()
    before = Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_b", "_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_b", "_p").orderBy(id_col, "piece")
    ranked = tagged.withColumn("_r", F.row_number().over(inside)).join(offsets, ["_b", "_p"])
    ranked = ranked.select(
        id_col, "piece", "start", "size", F.get(bound_of, F.col("_b").cast("int")).alias("bucket"),
        F.col("_b").cast("long").alias("_b"), (F.col("_before") + F.col("_r") - 1).alias("_rank"),
    )

    key = (plan.bucket + 1) << 44 | plan.start
    starts, each, base, containers = plan.start, plan.each, plan.base, max(1, plan.containers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, rank = b.column("_b").to_numpy(), b.column("_rank").to_numpy()
            out = rank % containers
            some = bucket > 0
            if some.any():
                i = np.searchsorted(key, bucket[some] << 44 | rank[some], side="right") - 1
                out[some] = base[i] + (rank[some] - starts[i]) // each[i]
            kept = [b.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.int64())], ["_id", "piece", "start", "size", "bucket", "container"])

    kind = ranked.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, piece int, start bigint, size bigint, bucket int, container bigint"
    packed = ranked.withColumnRenamed(id_col, "_id").mapInArrow(assign, schema)
    return packed.withColumnRenamed("_id", id_col)


def pack_documents(docs: DataFrame, capacity: int, path: str | None = None, top_up: bool = True) -> DataFrame:
    """``pack`` for the texts of ``docs``, sized by the ids of a public tokenizer."""
    sizes = materialize(count_tokens(docs, path), "sizes")
    return pack(sizes, capacity, top_up=top_up)


def broken_rules(docs: DataFrame, packed: DataFrame, capacity: int) -> DataFrame:
    """``rule, n``: counts that show whether a packing is whole: ``documents`` (rows of ``docs``), ``missing`` (ids without an
    item), ``overfull`` (containers over the capacity), ``cut_small`` (texts cut though they fit), ``torn`` (texts whose items
    don't follow one another from token 0 on). All but the first should be 0. Ids are taken as unique."""
    after = F.lead("start").over(Window.partitionBy("doc_id").orderBy("piece"))
    torn = F.coalesce(after != F.col("start") + F.col("size"), F.lit(False)) | ((F.col("piece") == 0) & (F.col("start") != 0))
    per = packed.withColumn("_torn", torn).groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("tokens"), F.bool_or("_torn").alias("torn"))
    n = lambda test: F.count(F.when(test, True))
    by_text = docs.select("doc_id").join(per, "doc_id", "left").agg(
        F.count("*").alias("documents"), n(F.col("pieces").isNull()).alias("missing"),
        n((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).alias("cut_small"), n(F.col("torn")).alias("torn"),
    )
    by_container = packed.groupBy("container").agg(F.sum("size").alias("used")).agg(n(F.col("used") > capacity).alias("overfull"))
    long = lambda row: row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in row.columns))))
    return long(by_text).unionByName(long(by_container))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens and the share of the capacity that is used."""
    by = packed.groupBy("container").agg(F.sum("size").alias("tokens"), F.count("*").alias("items"))
    return by.agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"), (F.sum("tokens") / (F.count("*") * capacity)).alias("fill"),
    )
