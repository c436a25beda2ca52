"""Queries of the engine's own operators over the driver's tables.

Roles: a trace row is one run of one function; rows of ``funcs`` without a name are the unknown functions, rows with one
the corpus; compilers and optimisation levels in the binary's label make the sides of match, triage and evaluate. The
``events`` table, ordered by time, serves as a raw access log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.functions import effects as E
from traceloom.functions import render
from traceloom.functions import signature as S
from traceloom.operators import access_log, corpus, eager, fingerprint, matching
from traceloom.plans import reports


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _funcs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "funcs")


def _built(funcs: DataFrame, *labels: str) -> DataFrame:
    test: Column | None = None
    for x in labels:
        hit = F.contains(F.col("binary"), F.lit(x))
        test = hit if test is None else test | hit
    return funcs.where(test)


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    funcs = _funcs(spark, sf)
    return funcs.where("name IS NULL"), funcs.where("name IS NOT NULL")


# ---- effects ---------------------------------------------------------------------------------------------------------


def effect_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token of every distinct effect, by column expressions."""
    e = _table(spark, sf, "traces").select(F.explode("effects").alias("e"))
    cols = ("kind", "region", "region_k", "off", "val", "val_k", "sym", "nr")
    distinct = e.select(*(F.col(f"e.{c}").alias(c) for c in cols)).distinct()
    return distinct.select(*cols, E.token(F.struct(*cols)).alias("token"))


def trace_complexity(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf, "traces").select("trace_id", "func_id", E.in_order(F.col("effects")).alias("e"), "capped")
    return t.select("trace_id", "func_id", E.complexity(F.col("e")).alias("complexity"), F.coalesce(F.size("e"), F.lit(0)).alias("n_effects"))


def trace_shingles(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct shingles of every trace."""
    rows = fingerprint.trace_shingles(_table(spark, sf, "traces"), "trace_id")
    return rows.select("trace_id", F.size("shingles").alias("n_shingles"))


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of every traced function; the signature as a digest of its decimal slots."""
    fp = fingerprint.fingerprints(_table(spark, sf, "traces"))
    return fp.select("func_id", "complexity", "shingles", "capped", F.md5(F.array_join("sig", ",")).alias("sig_md5"))


def fingerprint_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Functions whose stored fingerprint isn't the one that their traces give now."""
    now = fingerprint.fingerprints(_table(spark, sf, "traces")).withColumnRenamed("func_id", "id")
    was = _funcs(spark, sf).select("id", F.col("sig").alias("was"), F.col("complexity").alias("c"), F.col("shingles").alias("s"))
    moved = ~F.col("sig").eqNullSafe(F.col("was")) | (F.col("c") != F.col("complexity")) | (F.col("s") != F.col("shingles"))
    equal = F.coalesce(F.when(F.size("was") == C.SLOTS, S.equal_slots(F.col("sig"), F.col("was"))), F.lit(0))
    return now.join(was, "id").where(moved).select("id", equal.alias("equal_slots"))


def band_keys(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.derive_bands(_funcs(spark, sf))


def bands_stale(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.stale_bands(_funcs(spark, sf), _table(spark, sf, "bands"))


def bands_missing(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.missing_bands(_funcs(spark, sf), _table(spark, sf, "bands"))


# ---- corpus ----------------------------------------------------------------------------------------------------------


def well_formed(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.well_formed(_funcs(spark, sf)).select("id", "binary", "name", "entry", "source", "complexity", "shingles", "capped")


def index_summary(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.index_summary(_funcs(spark, sf))


def escaped_names(spark: SparkSession, sf: str) -> DataFrame:
    return _funcs(spark, sf).select("id", render.escape(F.col("name")).alias("name"), render.hex_entry(F.col("entry")).alias("entry"))


def signature_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Stored form of the signatures, as a digest, and whether reading it back gives the signature."""
    rows = _funcs(spark, sf).where(F.size("sig") == C.SLOTS).select("id", "sig", S.encode_signature(F.col("sig")).alias("b"))
    return rows.select("id", F.md5("b").alias("bytes_md5"), (S.decode_signature(F.col("b")) == F.col("sig")).alias("same"))


# ---- matching --------------------------------------------------------------------------------------------------------


def lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Per unknown function with enough signal the number of known ones that share a band."""
    target, known = _sides(spark, sf)
    pairs = matching.candidates(target.where(corpus.has_signal()), known.where(corpus.is_known()))
    return pairs.groupBy("target_id").agg(F.count("*").alias("candidates"))


def fallback_targets(spark: SparkSession, sf: str) -> DataFrame:
    target, known = _sides(spark, sf)
    wanted = corpus.well_formed(target).where(corpus.has_signal())
    return matching.without_candidate(wanted, known).select("id")


def best_matches(spark: SparkSession, sf: str) -> DataFrame:
    return matching.best_match(*_sides(spark, sf))


def query_named(spark: SparkSession, sf: str) -> DataFrame:
    return reports.query(*_sides(spark, sf))


def _triage(spark: SparkSession, sf: str) -> DataFrame:
    target, known = _sides(spark, sf)
    return reports.triage(target, _built(known, "-o0", "-o1"), _built(known, "-o2", "-o3"))


def triage_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _triage(spark, sf)


def triage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.triage_counts(_triage(spark, sf))


def triage_queue(spark: SparkSession, sf: str) -> DataFrame:
    return reports.review_queue(_triage(spark, sf)).select("id", "vuln_similarity", "lead")


def _match(spark: SparkSession, sf: str) -> DataFrame:
    funcs = corpus.well_formed(_funcs(spark, sf))
    return reports.match_by_name(_built(funcs, "-gx-"), _built(funcs, "-tc-", "-lv-"))


def match_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _match(spark, sf)


def match_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.match_summary(_match(spark, sf))


def match_changed(spark: SparkSession, sf: str) -> DataFrame:
    """The changed names that the report shows: the 40 least similar."""
    return reports.match_changed(_match(spark, sf))


def match_only_a(spark: SparkSession, sf: str) -> DataFrame:
    return reports.match_only(_match(spark, sf), "a")


def match_only_b(spark: SparkSession, sf: str) -> DataFrame:
    return reports.match_only(_match(spark, sf), "b")


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    funcs = _funcs(spark, sf)
    return reports.evaluate_ranks(_built(funcs, "-o2"), _built(funcs, "-o3"))


def eval_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(spark, sf)


def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.evaluate(_ranks(spark, sf))
    exact = ("scored", "rank1", "tp", "fp", "fn", "abstained")
    return out.select(*exact, *(F.round(c, 6).alias(c) for c in out.columns if c not in exact))


# ---- access log ------------------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an access log: 26 runs, one of them with half of the rows; purchases and errors execute, clicks read,
    views and signups write."""
    e = _table(spark, sf, "events").where("event_id IS NOT NULL")
    k = F.col("event_id")
    event = F.when(F.col("event_type") == "click", "read").when(F.col("event_type").isin("view", "signup"), "write").otherwise("insn")
    arg = F.lit(C.ARG_BASE) + (k % 6) * F.lit(C.ARG_STRIDE) + (k * 40) % 4096
    stack, glob, heap = F.lit(C.STACK_START) + (k % 128) - 64, F.lit(0x400000) + k % 512, F.lit(0x7000_0000) + (k * 4093) % 4_000_000
    addr = F.when(k % 5 < 2, arg).when(k % 5 == 2, stack).when(k % 5 == 3, glob).otherwise(heap)
    value = F.when(k % 4 == 0, F.lit(0)).when(k % 4 == 1, k % 9000 - 4500).when(k % 4 == 2, F.lit(C.ARG_BASE) + k % 3).otherwise(k * 1_000_003)
    insn = F.when(k % 7 == 0, "call").when(k % 7 == 1, "branch").when(k % 7 == 2, "syscall").when(k % 7 == 3, "ret").otherwise("plain")
    size = F.when(k % 11 == 0, 1).when(k % 11 == 1, 2).when(k % 11 == 2, 4).otherwise(8)
    # every other user is one of 25 runs, all others are one long run
    run = F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 25).otherwise(99)
    rows = e.select(
        run.cast("long").alias("run"), F.col("event_id").cast("long").alias("step"), event.alias("event"),
        F.when(event == "insn", F.lit(0x400000) + k % 64).otherwise(addr).cast("long").alias("addr"), size.alias("size"), value.cast("long").alias("value"),
        (k % 5 == 3).alias("in_segment"), F.when(event == "insn", insn).alias("insn"),
        F.when((k % 7 == 0) & (k % 2 == 0), F.concat(F.lit("f"), (k % 11).cast("string"))).alias("sym"), (k % 330).cast("long").alias("nr"),
    )
    done = F.count(F.when(F.col("event") == "insn", True)).over(access_log._running("run"))
    return rows.withColumn("instret", done)


def log_effects(spark: SparkSession, sf: str) -> DataFrame:
    """The effects of the runs under the default caps."""
    return access_log.effects_from_log(_log(spark, sf))


def log_first_touches(spark: SparkSession, sf: str) -> DataFrame:
    rows = access_log.first_touches(_log(spark, sf)).where("touched")
    return rows.select("run", "step", F.col("place.region").alias("region"), F.col("place.region_k").alias("region_k"))


def log_read_footprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = access_log.read_footprint(access_log.with_regions(_log(spark, sf))).where("field_read")
    return rows.select("run", "step", F.col("place.region").alias("region"), F.col("place.region_k").alias("region_k"), "off")


def value_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Class of the written values of all line items (price in cents off the middle)."""
    v = (F.round(F.col("l_extendedprice") * 100).cast("long") - 3_000_000).alias("v")
    rows = _table(spark, sf, "lineitem").select(v).select("v", E.classify_value(F.col("v")).alias("c"))
    return rows.select(F.col("c.val").alias("val"), F.col("c.val_k").alias("val_k")).groupBy("val", "val_k").agg(F.count("*").alias("n"))


def offset_buckets(spark: SparkSession, sf: str) -> DataFrame:
    v = (F.col("l_partkey") * 3 - F.col("l_suppkey") * 50).alias("v")
    rows = _table(spark, sf, "lineitem").select(E.bucket_offset(v).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"))


# ---- a few keys holding most records ---------------------------------------------------------------------------------


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return eager.heavy_values(_funcs(spark, sf)).select("field", "key_text")


def p6_profile(spark: SparkSession, sf: str) -> DataFrame:
    return eager.value_profile(_funcs(spark, sf))


def p6_guess_join(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate names joined with the functions of that name: per target the joined rows and summed complexity."""
    named = _table(spark, sf, "named").select("guess", "target")
    funcs = _funcs(spark, sf).select(F.col("name").alias("guess"), "complexity")
    right = eager.Side(funcs, sums={"complexity": F.col("complexity")})
    return eager.eager_join_aggregate(eager.Side(named, ["target"]), right, ["guess"], ["target"]).select("target", "n_rows", "complexity")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__}
    return {k: f for k, f in own.items() if k[0] != "_" and k != "queries"}
