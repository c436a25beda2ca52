"""Top N items within every group (problem 2): two-stage salted ranking of distinct items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def top_n_per_group(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    tie_break: Sequence[str],
    id_col: str,
    n: int = 3,
    valid: Column | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """The ``n`` best rows of every group, by higher ``score``, then ``tie_break`` ascending (null last), then smaller ``id_col``.

    Rows equal in group, score and tie_break are copies: only the one with the smallest ``id_col`` takes part. Copies are
    dropped before anything is ranked: partial aggregation leaves one of them per map task, so a group that consists of
    copies stays small on the way.

    Stage one hashes each group into ``salts`` subgroups by the item (score and tie columns) and keeps the ``n`` best of
    each; Spark also applies that limit before the shuffle, so a group of millions of items leaves at most ``n`` rows per
    task and subgroup. Stage two ranks the survivors, at most ``n * salts`` of a group.

    Defined cases: rows with a null or NaN score, or for which ``valid`` isn't true, take no part; a null in a group
    column forms a group of its own; empty input gives an empty result; further columns are left out, so their names
    can't clash. Returns group columns, ``id_col``, ``score``, ``tie_break`` and ``rank`` (1 to n).
    """
    survivors = _survivors(df, group, score, tie_break, id_col, n, valid, salts)
    whole = Window.partitionBy(*group).orderBy(*_best_first(score, tie_break))
    ranked = survivors.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n)
    return ranked.select(*group, id_col, score, *tie_break, "rank")


def _best_first(score: str, tie_break: Sequence[str]) -> list[Column]:
    return [F.col(score).desc(), *(F.col(c).asc_nulls_last() for c in tie_break)]


def _survivors(
    df: DataFrame, group: Sequence[str], score: str, tie_break: Sequence[str], id_col: str, n: int, valid: Column | None, salts: int
) -> DataFrame:
    """Stage one: the ``n`` best distinct items of every subgroup."""
    items = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    if valid is not None:
        items = items.where(valid)
    # -0.0 and 0.0 are one score
    items = items.select(*group, id_col, (F.col(score) + F.lit(0.0)).alias(score), *tie_break)
    distinct = items.groupBy(*group, score, *tie_break).agg(F.min(id_col).alias(id_col))
    salted = distinct.withColumn("_salt", F.pmod(F.xxhash64(score, *tie_break), F.lit(salts)).cast("int"))
    within = Window.partitionBy(*group, "_salt").orderBy(*_best_first(score, tie_break))
    return salted.withColumn("_place", F.row_number().over(within)).where(F.col("_place") <= n).drop("_place")


def top_guesses(named: DataFrame, n: int = 3) -> DataFrame:
    """Best guesses for every ``(target, entry)`` of ``named``; similarity must lie in [0, 1] and entry be known."""
    valid = F.col("entry").isNotNull() & F.col("similarity").between(0.0, 1.0)
    return top_n_per_group(named, ["target", "entry"], "similarity", ["guess", "from_binary"], "named_id", n, valid)
