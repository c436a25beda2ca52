"""Per-key results without skew (problem 6): eager aggregation through joins.

Both inputs are aggregated by the join key before they meet, so a key that holds a third of the rows is one compact
state per input: Spark's partial aggregation shrinks it inside each map task, and the join sees one row per key and
group. Sums of a side are multiplied by the other side's row count, counts are multiplied, extremes pass through.
Distinct counts come from a first aggregation by (key, value), whose groups are small whatever the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Side:
    """One input of a join that is never made: what to keep of it per join key.

    ``group`` are further grouping columns, ``sums`` measures to add up, ``lows`` and ``highs`` extremes, ``distinct`` names one
    column whose different values are counted (null isn't one), as ``distinct_as``.
    """

    df: DataFrame
    group: Sequence[str] = ()
    sums: Mapping[str, Column] = field(default_factory=dict)
    lows: Mapping[str, Column] = field(default_factory=dict)
    highs: Mapping[str, Column] = field(default_factory=dict)
    distinct: str | None = None
    distinct_as: str = "n_distinct"

    def state(self, on: Sequence[str], tag: str) -> DataFrame:
        """One row per join key and group, by partial aggregation alone; with ``distinct`` in two steps, first by its values too."""
        keys, known = [*on, *self.group], self.df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in on))
        name = lambda k: f"_{tag}_{k}"
        aggs = [F.count(F.lit(1)).alias(name("n")), *(F.sum(c).alias(name(k)) for k, c in self.sums.items())]
        aggs += [F.min(c).alias(name(k)) for k, c in self.lows.items()] + [F.max(c).alias(name(k)) for k, c in self.highs.items()]
        if self.distinct is None:
            return known.groupBy(*keys).agg(*aggs)
        fine = known.groupBy(*keys, self.distinct).agg(*aggs)
        again = [F.sum(name(k)).alias(name(k)) for k in ("n", *self.sums)] + [F.min(name(k)).alias(name(k)) for k in self.lows]
        again += [F.max(name(k)).alias(name(k)) for k in self.highs]
        return fine.groupBy(*keys).agg(*again, F.count(self.distinct).alias(name(self.distinct_as)))


def eager_join_aggregate(left: Side, right: Side, on: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """``left JOIN right USING (on) GROUP BY by`` without making the joined rows.

    ``by`` names columns of ``on`` and the sides' groups (all of them if None). Gives ``by``, ``n_rows`` (joined rows),
    ``left_rows`` and ``right_rows`` (rows of a side that have a partner, each once for every group it falls into), the
    sums over the joined rows (each row of one side counts as often as the other has partners), the extremes, and the
    distinct counts, which only exist where nothing is rolled up: for ``by`` the join key itself and no groups.

    Null keys join nothing, null measures add nothing (a group of only nulls sums to null), repeated rows count each,
    an empty side gives no rows. Column names of the inputs can't clash: only the named ones are kept.
    """
    whole = [*on, *left.group, *right.group]
    by = whole if by is None else list(by)
    if (left.distinct or right.distinct) and (list(by) != list(on) or len(whole) > len(on)):
        raise ValueError("distinct counts can't be rolled up")
    states = left.state(on, "l").join(right.state(on, "r"), list(on))
    out = [F.sum(F.col("_l_n") * F.col("_r_n")).alias("n_rows"), F.sum("_l_n").alias("left_rows"), F.sum("_r_n").alias("right_rows")]
    for side, tag, other in ((left, "l", "r"), (right, "r", "l")):
        out += [F.sum(F.col(f"_{tag}_{k}") * F.col(f"_{other}_n")).alias(k) for k in side.sums]
        out += [F.min(f"_{tag}_{k}").alias(k) for k in side.lows] + [F.max(f"_{tag}_{k}").alias(k) for k in side.highs]
        out += [F.max(f"_{tag}_{side.distinct_as}").alias(side.distinct_as)] if side.distinct else []
    return states.groupBy(*by).agg(*out)


def value_profile(funcs: DataFrame) -> DataFrame:
    """For every value of ``complexity``, ``shingles`` and ``sig`` the number of rows, binaries and names and the first and last ``indexed_at``.

    Returns ``field, key_text, n_rows, n_binaries, n_names, first_indexed, last_indexed``. ``key_text`` is the value in
    decimal or, for sig, the smallest id of its rows. That is ``eager_join_aggregate`` of the values with their binaries and
    the values with their names: the rows of a value on either side never meet, only its two states do. A null isn't a
    value, a null binary or name isn't counted, signatures of other lengths than 128 slots take no part, repeated rows
    count each, an empty table gives no rows. Signatures are brought together by 128 bits of digest.
    """

    def number(name: str) -> Column:
        key = F.col(name).cast("long")
        return F.when(key.isNotNull(), F.struct(F.lit(name).alias("field"), key.alias("k1"), F.lit(0).cast("long").alias("k2")))

    digest = F.struct(F.lit("sig").alias("field"), F.xxhash64("sig").alias("k1"), F.xxhash64(F.lit(1), F.col("sig")).alias("k2"))
    values = F.array_compact(F.array(number("complexity"), number("shingles"), F.when(F.size("sig") == 128, digest)))
    at = F.col("indexed_at")
    binaries = Side(
        funcs.select("id", "binary", "indexed_at", F.inline(values)), lows={"id": F.col("id"), "first_indexed": at}, highs={"last_indexed": at}, distinct="binary", distinct_as="n_binaries",
    )
    names = Side(funcs.select("name", F.inline(values)), distinct="name", distinct_as="n_names")
    made = eager_join_aggregate(binaries, names, ["field", "k1", "k2"])
    text = F.when(F.col("field") == "sig", F.col("id")).otherwise(F.col("k1")).cast("string")
    return made.select("field", text.alias("key_text"), F.col("left_rows").alias("n_rows"), "n_binaries", "n_names", "first_indexed", "last_indexed")


def heavy_values(funcs: DataFrame, share: float = 0.025) -> DataFrame:
    """The values of ``value_profile`` that at least ``share`` of all rows of ``funcs`` hold. Counts the rows when the plan is built."""
    total = funcs.count()
    return value_profile(funcs).where(F.col("n_rows") >= F.lit(share * total))
