"""Places of rows in a total order, without gathering them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators.shared import materialize


def constants(values: list[int], kind: str = "bigint") -> Column:
    """A constant array; one text literal that the optimizer folds, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def number_rows(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with ``place``, counted from 1 in the order given (null first; rows that tie stand in any order).

    Rows are range-partitioned and sorted, each task numbers its own range, and the ranges' sizes (one number per task,
    on the driver) give where each begins. The rows are stored in between, so both steps see the same ranges. Runs jobs
    when the plan is built.
    """
    return number_as_is(df.repartitionByRange(*order).sortWithinPartitions(*order))


def number_as_is(df: DataFrame) -> DataFrame:
    """``df`` with ``place``, counted from 1 in the order that its rows have, as after ``orderBy``."""
    # the upper bits name the task, the lower 33 count its rows
    held = materialize(df.withColumn("_n", F.monotonically_increasing_id()), "ranged")
    task = F.shiftright("_n", 33).cast("int")
    sizes = {r.t: r["count"] for r in held.groupBy(task.alias("t")).count().collect()}
    before = list(accumulate((sizes.get(t, 0) for t in range(max(sizes, default=0))), initial=0))
    place = F.get(constants(before), task) + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.withColumn("place", place).drop("_n")
