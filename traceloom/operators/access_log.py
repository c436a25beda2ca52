"""From a raw access log to effects.

A log has one row per event of a run, totally ordered by ``step`` inside ``run``: instructions (``event`` = insn) and the
memory accesses (read, write) that they make. Columns:

``run, step, event, instret, addr, size, value, in_segment, insn, sym, nr`` where ``addr`` is the instruction's or the
accessed address, ``insn`` the instruction's kind (``effects.instruction_kind``), ``sym`` the name of a direct call's
target, ``nr`` a syscall's number and ``value`` what is written or, for ret, what is returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.functions import effects as E

LOG = "run bigint, step bigint, event string, instret bigint, addr bigint, size int, value bigint, in_segment boolean, insn string, sym string, nr bigint"


@dataclass(frozen=True)
class Caps:
    """Bounds of a run."""

    instructions: int = C.MAX_INSTRUCTIONS
    visits: int = C.MAX_VISITS
    effects: int = C.MAX_EFFECTS
    reads: int = C.MAX_READS
    heap_pages: int = C.MAX_HEAP_PAGES
    run_pages: int = C.MAX_RUN_PAGES


def _ordered(*keys: str):
    return Window.partitionBy(*keys).orderBy("step")


def _running(*keys: str):
    return _ordered(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _count(test: Column) -> Column:
    return F.count(F.when(test, True))


def with_regions(log: DataFrame) -> DataFrame:
    """Adds ``place`` (region, region_k, off) of accesses and ``touch``, what a first touch is remembered by."""
    access = F.col("event").isin("read", "write")
    place = F.when(access, E.classify_address(F.col("addr"), F.coalesce("in_segment", F.lit(False))))
    page = F.col("addr") - F.col("addr").bitwiseAND(F.lit(C.PAGE - 1))
    region = F.col("place.region")
    touch = (
        F.when(region == "arg", F.concat(F.lit("arg"), F.col("place.region_k").cast("string"))).when(region == "global", "global")
        .when(region == "heapish", F.concat(F.lit("page"), page.cast("string")))
    )
    return log.withColumn("place", place).withColumn("touch", touch)


def first_touches(log: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """Adds ``touched``: the access opens a region of its run that is told. Each argument and the globals are told once,
    heap pages once each and only the first ``caps.heap_pages`` of them; the stack never."""
    rows = with_regions(log)
    new = F.col("touch").isNotNull() & (F.row_number().over(_ordered("run", "touch")) == 1)
    rows = rows.withColumn("_new", new)
    heap = F.col("_new") & (F.col("place.region") == "heapish")
    told = _count(heap).over(_running("run")) <= caps.heap_pages
    return rows.withColumn("touched", F.col("_new") & (~heap | told)).drop("_new")


def read_footprint(rows: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """Adds ``off`` (bucketed) and ``field_read``: the access is the run's first read of a field outside the stack and
    among the first ``caps.reads`` of them. Later fields are remembered but not told."""
    place = F.struct("place.region", "place.region_k", "off")
    rows = rows.withColumn("off", E.bucket_offset(F.col("place.off")))
    read = (F.col("event") == "read") & (F.col("place.region") != "stack")
    # reads of one field are numbered among themselves, so other events don't count
    rows = rows.withColumn("_f", F.when(read, place))
    first = F.coalesce(read, F.lit(False)) & (F.row_number().over(_ordered("run", "_f")) == 1)
    rows = rows.withColumn("_first", first)
    return rows.withColumn("field_read", F.col("_first") & (_count(F.col("_first")).over(_running("run")) <= caps.reads)).drop("_f", "_first")


def cap_prefix(rows: DataFrame, told: Column, caps: Caps = Caps()) -> DataFrame:
    """The rows of each run before it is cut off, with ``cut``: whether it was.

    A run stops at the first instruction that visits an address too often, is one too many or starts with too many
    effects, at the first write that starts with too many effects, or at the first access that needs a page too many.
    ``told`` is the number of effects of a row.
    """
    before = F.coalesce(F.sum(told).over(_ordered("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    visits = _count(F.col("event") == "insn").over(_running("run", "event", "addr"))
    new_page = (F.col("place.region") == "heapish") & (F.row_number().over(_ordered("run", "touch")) == 1)
    rows = rows.withColumns({"_before": before, "_visits": visits, "_page": F.coalesce(new_page, F.lit(False))})
    full = F.col("_before") >= caps.effects
    stop = (F.col("event") == "insn") & ((F.col("_visits") > caps.visits) | (F.col("instret") > caps.instructions) | full)
    stop |= (F.col("event") == "write") & full
    stop |= F.col("_page") & (_count(F.col("_page")).over(_running("run")) > caps.run_pages)
    end = F.min(F.when(stop, F.col("step"))).over(Window.partitionBy("run"))
    rows = rows.withColumn("_end", end)
    spent = F.max("instret").over(Window.partitionBy("run")) >= caps.instructions
    kept = rows.where(F.col("_end").isNull() | (F.col("step") < F.col("_end")))
    return kept.withColumn("cut", F.col("_end").isNotNull() | spent).drop("_before", "_visits", "_page", "_end")


def effects_from_log(log: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """``run, seq, ic, kind, region, region_k, off, val, val_k, sym, nr``: the effects of each run in order.

    An access can open a region and then be read or write a field; calls, syscalls, conditional branches and returns are
    effects of their instruction; a run that was cut off ends with a capped effect, so it can hold one more than the
    bound. Runs without effects have no row unless they were cut; null addresses have no effect.
    """
    log = log.repartition("run")  # the one shuffle: all windows are over the run, or over a part of it
    rows = read_footprint(first_touches(log, caps), caps)
    place = {k: F.col(f"place.{k}") for k in ("region", "region_k")}
    null = {"region": "string", "region_k": "int", "off": "int", "val": "string", "val_k": "bigint", "sym": "string", "nr": "bigint"}

    def effect(kind: str, **cols: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *(cols.get(k, F.lit(None)).cast(t).alias(k) for k, t in null.items()))

    written = E.classify_value(E.mask_to_size(F.col("value"), F.col("size")))
    returned = E.classify_value(F.col("value"))
    outside = F.col("place.region").isNotNull() & (F.col("place.region") != "stack")
    made = F.array_compact(
        F.array(
            F.when(F.col("touched"), effect("new_region", **place)),
            F.when(F.col("field_read"), effect("read", off=F.col("off"), **place)),
            F.when((F.col("event") == "write") & outside, effect("write", off=F.col("off"), val=written["val"], val_k=written["val_k"], **place)),
            F.when(F.col("insn") == "call", effect("call", sym=F.col("sym"))),
            F.when(F.col("insn") == "syscall", effect("syscall", nr=F.col("nr").bitwiseAND(F.lit(0xFFFFFFFF)))),
            F.when(F.col("insn") == "branch", effect("branch")),
            F.when(F.col("insn") == "ret", effect("ret", val=returned["val"], val_k=returned["val_k"])),
        )
    )
    kept = cap_prefix(rows.withColumn("_made", made), F.size("_made"), caps)
    told = kept.select("run", "step", F.col("instret").alias("ic"), "cut", F.posexplode("_made").alias("_i", "_e"))
    order = Window.partitionBy("run").orderBy("step", "_i")
    listed = told.select("run", (F.row_number().over(order) - 1).alias("seq"), "ic", "_e.*")
    # the instruction of the cut is retired even where it left no effect
    ends = log.groupBy("run").agg(F.max("instret").alias("_all")).join(
        kept.groupBy("run").agg(F.bool_or("cut").alias("cut"), F.sum(F.size("_made")).alias("seq"), F.max("instret").alias("ic")), "run", "left"
    )
    capped = ends.where(F.coalesce("cut", F.lit(True))).select(
        "run", F.coalesce("seq", F.lit(0)).cast("int").alias("seq"), F.coalesce("ic", F.lit(0)).cast("long").alias("ic"), effect("capped").alias("_e")
    )
    return listed.unionByName(capped.select("run", "seq", "ic", "_e.*"))


def branch_outcomes(log: DataFrame, target: str = "target") -> DataFrame:
    """``run, step, taken``: whether each conditional branch with a known ``target`` went there, seen at the next instruction.
    A branch at a run's end has no outcome."""
    insns = log.where("event = 'insn'").withColumn("_next", F.lead("addr").over(_ordered("run")))
    seen = insns.where((F.col("insn") == "branch") & F.col(target).isNotNull() & F.col("_next").isNotNull())
    return seen.select("run", "step", (F.col("_next") == F.col(target)).alias("taken"))


def plans(runs: DataFrame, outcomes: DataFrame, depth: int, seeds: tuple[int, ...] = C.SEEDS) -> DataFrame:
    """``run, seed_ix, path, plan``: per seed the natural run (path 0, no plan) and, for each of its first ``depth`` branches, one
    run that follows it up to that branch and goes the other way there. With depth 0 that is one run per seed."""
    seeded = runs.select("run", F.posexplode(F.array(*(F.lit(s) for s in seeds))).alias("seed_ix", "seed"))
    taken = F.transform(F.array_sort(F.collect_list(F.struct("step", "taken"))), lambda x: x["taken"])
    dirs = outcomes.groupBy("run").agg(F.slice(taken, 1, max(1, depth)).alias("dirs"))
    joined = seeded.join(dirs, "run", "left").withColumn("dirs", F.coalesce("dirs", F.array().cast("array<boolean>")))
    ways = F.sequence(F.lit(0), F.least(F.size("dirs"), F.lit(depth)))
    spread = joined.select("run", "seed_ix", "dirs", F.explode(ways).alias("path"))
    flipped = F.concat(F.slice("dirs", 1, F.col("path") - 1), F.array(~F.get("dirs", F.col("path") - 1)))
    plan = F.when(F.col("path") == 0, F.array().cast("array<boolean>")).otherwise(flipped)
    return spread.select("run", "seed_ix", "path", plan.alias("plan"))
