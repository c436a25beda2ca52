"""Candidates by shared bands, the exact fallback and the best match in a corpus.

Rows of one signature are one class on either side, so a signature that a third of the corpus shares is compared once.
Trivial functions fill the largest band buckets; they can't be anyone's match, so they only take part in the question
whether a target has any candidate, and that one is asked of distinct (band, key), for the targets that have no other.

The classes of either side and each corpus's winners are stored once. Two classes with b equal bands agree in 4 b slots at
least and in 96 + b at most, so only pairs that could still be the best of their target are compared slot by slot.
Of a bucket that very many target classes share no pairs are made at all: it is passed in blocks (``operators/blocks``).
So the pairs are at most ``HOT_BUCKET`` for each band of a known class.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.functions.signature import equal_slots
from traceloom.operators.blocks import against_all, best_with_tag
from traceloom.operators.corpus import derive_bands, has_signal, is_known, well_formed
from traceloom.operators.shared import materialize

#: Target classes in one bucket from which on the bucket is passed in blocks.
HOT_BUCKET = 2000


def _digests(*more: str | Column) -> list[str | Column]:
    return [*more, F.xxhash64("sig").alias("h1"), F.xxhash64(F.lit(1), F.col("sig")).alias("h2")]


def _classes(funcs: DataFrame, *keep: str) -> DataFrame:
    """One row per signature: the smallest id's fields as ``rep, *keep`` with ``h1, h2, sig``."""
    rows = funcs.select(*_digests("id", "sig", *keep))
    first = F.min_by(F.struct(F.col("id").alias("rep"), *keep), "id").alias("_f")
    return rows.groupBy("h1", "h2").agg(first, F.any_value("sig").alias("sig")).select("h1", "h2", "_f.*", "sig")


def _bands(classes: DataFrame, name: str) -> DataFrame:
    return derive_bands(classes.select(F.col("rep").alias("id"), "sig")).withColumnRenamed("func_id", name)


def band_set(funcs: DataFrame) -> DataFrame:
    """``band, key`` of all rows; a signature that a batch holds many times gives its keys once."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                both = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], axis=1)
                first = np.unique(both, axis=0, return_index=True)[1]
                yield b.select(["sig"]).take(pa.array(first))

    sigs = funcs.select(*_digests("sig")).mapInArrow(once, "sig array<bigint>")
    return derive_bands(sigs.select(F.lit(0).alias("id"), "sig")).select("band", "key")


def candidates(target: DataFrame, corpus: DataFrame) -> DataFrame:
    """``target_id, func_id``: rows that share a key in the same band, each pair once. No gate applies.

    The pairs of rows themselves, for inspection; ``best_match`` works on classes instead.
    """
    t = derive_bands(well_formed(target)).withColumnRenamed("func_id", "target_id")
    return t.join(derive_bands(well_formed(corpus)), ["band", "key"]).select("target_id", "func_id").distinct()


def stored_candidates(target: DataFrame, funcs: DataFrame, bands: DataFrame) -> DataFrame:
    """``target_id, func_id`` by a stored band index (``func_id, band, key``) instead of derived bands.

    The index is taken as it is: rows delivered twice count once, ids without a well-formed row in ``funcs`` are skipped,
    keys out of date find what they name.
    """
    t = derive_bands(well_formed(target)).withColumnRenamed("func_id", "target_id")
    pairs = t.join(bands.select("band", "key", "func_id"), ["band", "key"]).select("target_id", "func_id").distinct()
    return pairs.join(well_formed(funcs).select(F.col("id").alias("func_id")), "func_id", "left_semi").select("target_id", "func_id")


def without_candidate(target: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows of ``target`` (with an ``id``) that share no band with any row of the corpus, gated or not."""
    own = derive_bands(target)
    # the corpus streams past the targets' keys
    seen = band_set(well_formed(corpus)).join(own.select("band", "key").distinct(), ["band", "key"], "left_semi").distinct()
    hit = own.join(seen, ["band", "key"], "left_semi").select(F.col("func_id").alias("id")).distinct()
    return target.join(hit, "id", "left_anti")


@dataclass(frozen=True)
class Seekers:
    """Targets with enough signal, ready for lookups in one or more corpora."""

    rows: DataFrame
    classes: DataFrame
    bands: DataFrame
    #: Buckets (``band, key``) with more than ``HOT_BUCKET`` classes; None if there is none.
    hot: DataFrame | None


def seek(target: DataFrame) -> Seekers:
    """Prepare the rows of ``target`` with enough signal; malformed ones are skipped. Stores one row per signature."""
    wanted = well_formed(target).where(has_signal())
    classes = materialize(_classes(wanted), "seekers")
    bands = _bands(classes, "t")
    hot = bands.groupBy("band", "key").count().where(F.col("count") > HOT_BUCKET).select("band", "key")
    return Seekers(wanted.select(*_digests("id")), classes, bands, None if hot.isEmpty() else hot)


def _in_hot_buckets(seekers: Seekers, known: DataFrame) -> DataFrame:
    """``t, c, equal``: the best known class of each hot bucket for each class that lies in it. The bucket's pairs are
    compared in blocks and aren't made."""
    tag = F.xxhash64("band", "key").alias("tag")
    t = seekers.bands.join(seekers.hot, ["band", "key"], "left_semi").select(F.col("t").alias("q"), tag)
    c = _bands(known, "c").join(seekers.hot, ["band", "key"], "left_semi").select(F.col("c").alias("place"), tag)
    asked = t.join(seekers.classes.select(F.col("rep").alias("q"), "sig"), "q")
    found = best_with_tag(asked, c.join(known.select(F.col("rep").alias("place"), "sig"), "place"))
    return found.select(F.col("q").alias("t"), F.col("place").alias("c"), F.col("equal").cast("int").alias("equal"))


def best_match(target: DataFrame, corpus: DataFrame) -> DataFrame:
    """For each row of ``target`` with enough signal its most similar known function of the corpus.

    Returns ``id, similarity, guess, from_binary, func_id``. The pool is the rows that share a band; only if no row at all
    does, it is the whole corpus (then also a similarity of 0 can win). Of the pool only rows with a name and complexity
    of at least 4 count; a target whose pool holds none has no row. Ties go to the smallest id. Malformed rows on either
    side are skipped; copies of a target get a row each. Building the plan runs jobs, as intermediate tables are stored.
    """
    return best_in_each(target, [corpus])[0]


def best_in_each(target: DataFrame, corpora: Sequence[DataFrame]) -> list[DataFrame]:
    """``best_match`` of one target in several corpora. The target is prepared once, beside the corpora; these are worked on
    side by side."""
    known = lambda corpus: materialize(_classes(well_formed(corpus).where(is_known()), "name", "binary"), "known")
    with ThreadPoolExecutor(len(corpora) + 1) as pool:
        seekers, prepared = pool.submit(seek, target), [pool.submit(known, c) for c in corpora]
        return list(pool.map(lambda c, k: _lookup(seekers.result(), c, k.result()), corpora, prepared))


def _lookup(seekers: Seekers, corpus: DataFrame, known: DataFrame) -> DataFrame:
    bands, unseen = seekers.bands, F.lit(0)
    if seekers.hot is not None:
        # equal bands in hot buckets aren't counted, so they could add to any pair of their target
        own = bands.join(seekers.hot.withColumn("hot", F.lit(1)), ["band", "key"], "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
        bands = own.withColumn("h", F.sum("hot").over(Window.partitionBy("t"))).where("hot = 0").drop("hot")
        unseen = F.max("h")
    pairs = bands.join(_bands(known, "c"), ["band", "key"]).groupBy("t", "c").agg(F.count("*").cast("int").alias("b"), unseen.alias("h"))
    most = F.max("b").over(Window.partitionBy("t"))
    near = pairs.withColumn("most", most).where(F.col("b") + F.col("h") + (C.SLOTS - C.BANDS) >= F.col("most") * C.BAND_ROWS).select("t", "c")
    sig_t = seekers.classes.select(F.col("rep").alias("t"), F.col("sig").alias("sig_t"))
    told = known.select(F.col("rep").alias("c"), F.col("sig").alias("sig_c"), F.col("name").alias("guess"), F.col("binary").alias("from_binary"))
    scored = near.join(sig_t, "t").join(told, "c").select("t", "c", equal_slots(F.col("sig_t"), F.col("sig_c")).alias("equal"), "guess", "from_binary")
    if seekers.hot is not None:
        names = known.select(F.col("rep").alias("c"), F.col("name").alias("guess"), F.col("binary").alias("from_binary"))
        scored = scored.unionByName(_in_hot_buckets(seekers, known).join(names, "c"))
    first = F.min_by(F.struct("c", "equal", "guess", "from_binary"), F.struct((-F.col("equal")).alias("e"), F.col("c"))).alias("_b")
    best = materialize(scored.groupBy("t").agg(first).select("t", "_b.*"), "best")

    # rows that can't be a match still tell that a target has a candidate
    alone = seekers.classes.join(best.select(F.col("t").alias("rep")), "rep", "left_anti").select(F.col("rep").alias("id"), "sig")
    lost = materialize(without_candidate(alone, well_formed(corpus).where(~F.coalesce(is_known(), F.lit(False)))), "lost")
    if n_lost := lost.count():
        asked = lost.select(F.col("id").alias("q"), "sig", F.lit(C.SLOTS).alias("bar"), F.lit(0).alias("bar_place"))
        scanned = against_all(asked, known.select(F.col("rep").alias("place"), "sig"), stored=True, asked=n_lost)
        names = known.select(F.col("rep").alias("top_place"), F.col("name").alias("guess"), F.col("binary").alias("from_binary"))
        scanned = scanned.join(names, "top_place")
        best = best.unionByName(scanned.select(F.col("q").alias("t"), F.col("top_place").alias("c"), F.col("top_equal").cast("int").alias("equal"), "guess", "from_binary"))

    found = best.join(seekers.classes.select(F.col("rep").alias("t"), "h1", "h2"), "t")
    similarity = (F.col("equal") / F.lit(C.SLOTS)).alias("similarity")
    return seekers.rows.join(found, ["h1", "h2"]).select("id", similarity, "guess", "from_binary", F.col("c").alias("func_id"))
