"""From functions to an index, with the machine that makes traces behind a boundary."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators import corpus
from traceloom.operators.access_log import effects_from_log
from traceloom.operators.fingerprint import fingerprints
from traceloom.sources import elf, image

#: Gives traces (``func_id, effects, capped``) for functions (``func_id, binary, entry, size``) and their segments.
TraceProvider = Callable[[DataFrame, DataFrame], DataFrame]


def from_traces(functions: DataFrame, traces: DataFrame) -> DataFrame:
    """Functions (``func_id, binary, name, entry, source``) with the fingerprints of their traces; ``func_id`` becomes ``id``.
    Functions without a trace are left out."""
    fp = fingerprints(traces).drop("bands")
    cols = ("binary", "name", "entry", "source")
    return functions.select("func_id", *cols).join(fp, "func_id").select(F.col("func_id").alias("id"), *cols, "complexity", "shingles", "capped", "sig")


def traces_provider(traces: DataFrame) -> TraceProvider:
    """Stored traces (``binary, entry, effects, capped``) of the functions that are found in the files."""

    def provide(functions: DataFrame, segments: DataFrame) -> DataFrame:
        return traces.join(functions.select("binary", "entry", "func_id"), ["binary", "entry"]).select("func_id", "effects", "capped")

    return provide


def log_provider(log: DataFrame, named: DataFrame | None = None) -> TraceProvider:
    """Traces from a stored access log (``access_log.LOG`` without ``run``, ``in_segment`` and ``sym``) with ``binary, entry,
    seed_ix`` and ``target``, where a direct call goes.

    Which addresses lie in the binary comes from its segments, the names of called functions from its functions (or from
    ``named``). A function without a row in the log has no trace.
    """

    def provide(functions: DataFrame, segments: DataFrame) -> DataFrame:
        own = log.join(functions.select("binary", "entry", "func_id"), ["binary", "entry"]).drop("entry")
        placed = elf.in_segments(own, segments).drop("segment")
        keyed = elf.name_calls(placed, functions if named is None else named).withColumn("run", F.xxhash64("func_id", "seed_ix"))
        made = effects_from_log(keyed)
        fields = [c for c in made.columns if c != "run"]
        lists = made.groupBy("run").agg(F.collect_list(F.struct(*fields)).alias("effects"), F.bool_or(F.col("kind") == "capped").alias("capped"))
        return keyed.select("run", "func_id").distinct().join(lists, "run", "left").drop("run")

    return provide


def index_files(spark: SparkSession, path: str, provider: TraceProvider, strict: bool = True) -> DataFrame:
    """Index of the executable files at ``path``: discover functions, keep those with code, trace, fingerprint."""
    functions, segments, _ = elf.read(spark, path, strict)
    return index_functions(functions, segments, provider)


def index_functions(functions: DataFrame, segments: DataFrame, provider: TraceProvider) -> DataFrame:
    """As ``index_files``, from functions and segments that have been read."""
    found = elf.indexable(functions, segments).withColumn("func_id", F.xxhash64("binary", "entry"))
    return from_traces(found, provider(found, segments))


def as_index(stored: DataFrame) -> DataFrame:
    """Functions of a corpus image as an index: bad signatures are an error, every source reads symtab."""
    return corpus.checked(stored).withColumn("source", F.lit("symtab"))


def load_index(spark: SparkSession, path: str, provider: TraceProvider | None = None) -> DataFrame:
    """An index by the form of ``path``: a corpus image (``.db``, every source then reads symtab), a folder written by
    ``Corpus.write``, or executable files, which need a provider."""
    if PurePosixPath(path).suffix == ".db":
        return as_index(image.read(spark, path))
    if provider is None:
        return corpus.Corpus.read(spark, path).funcs
    return index_files(spark, path, provider)


def failed_runs(functions: DataFrame) -> DataFrame:
    """``func_id, effects, capped`` for functions whose run couldn't be set up: a single capped effect, which is still a
    (short) fingerprint. For providers, to be united with the traces that they have."""
    from traceloom.functions.effects import EFFECT

    null = F.lit(None)
    names = [x.split(":") for x in EFFECT[len("struct<") : -1].split(",")]
    fields = {"seq": F.lit(0), "ic": F.lit(0), "kind": F.lit("capped")}
    only = F.struct(*(fields.get(n, null).cast(t).alias(n) for n, t in names))
    return functions.select("func_id", F.array(only).alias("effects"), F.lit(True).alias("capped"))
