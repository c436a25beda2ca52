"""Queries of sources, sinks and trace operators that the plain tables don't exercise by themselves.

Files are built from ``funcs``: one per ``binary`` label, a function's ``complexity`` as its size. They are read back by the
same reader that reads files from disk. Instructions, counters and addresses come from ``events`` and ``orders``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.functions import effects as E
from traceloom.functions import signature as S
from traceloom.operators import access_log, corpus, fingerprint, matching, numbering
from traceloom.operators.shared import materialize, work_folder
from traceloom.plans import index, reports
from traceloom.plans.queries import _built, _funcs, _log, _sides, _table
from traceloom.sources import elf, elf_build, image
from traceloom.streaming import ingest

_FIELDS = ("binary", "name", "entry", "source", "complexity", "shingles", "capped")


def _sig_md5(sig: Column | str = "sig") -> Column:
    return F.md5(F.array_join(sig, ",")).alias("sig_md5")


# ---- executable files ------------------------------------------------------------------------------------------------


def _loads() -> Column:
    """One segment for most labels, two for those of an even length; together they hold only a part of the functions."""
    load = lambda v, m: F.struct(F.lit(v).cast("long").alias("vaddr"), F.lit(m).cast("long").alias("size"))
    first = load(0x400000, 0x8000)
    return F.when(F.length("binary") % 2 == 0, F.array(first, load(0, 0x8000))).otherwise(F.array(first))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    rows = _funcs(spark, sf).select("binary", "id", "name", "entry", F.col("complexity").alias("size"), "source")
    return elf_build.files(rows, _loads())


def _read(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return elf.split(materialize(elf.parse_files(_files(spark, sf)), "elf"))


def elf_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions found in files built from all rows: by symbols, or by unwind records where a binary has no names."""
    return _read(spark, sf)[0]


def elf_order(spark: SparkSession, sf: str) -> DataFrame:
    """Place of each function among those of its file, as the reader gives them: by unsigned entry."""
    placed = numbering.number_as_is(elf.parse_files(_files(spark, sf)).where("kind = 'function'").select("binary", "entry"))
    first = placed.groupBy("binary").agg(F.min("place").alias("_first"))
    return placed.join(first, "binary").select("binary", "entry", (F.col("place") - F.col("_first")).alias("place"))


def elf_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf)[1].select("binary", "segment", "vaddr", F.length("bytes").alias("n_bytes"), "mem_size", "exec", "write")


def elf_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Segments as they lie in memory."""
    whole = elf.whole_bytes(_read(spark, sf)[1])
    return whole.select("binary", "segment", F.length("bytes").alias("n_bytes"), F.md5("bytes").alias("bytes_md5"))


def mapped_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that the functions of each binary touch, a function taken as 300 bytes for each point of its complexity."""
    return elf.mapped_pages(_funcs(spark, sf).select("binary", F.col("entry").alias("vaddr"), (F.col("complexity") * 300).alias("mem_size")))


def elf_indexable(spark: SparkSession, sf: str) -> DataFrame:
    functions, segments, _ = _read(spark, sf)
    return elf.indexable(functions, segments).select("binary", "entry")


def elf_refused(spark: SparkSession, sf: str) -> DataFrame:
    """Files with one fault each, chosen by the label's length, and what the reader says about them."""
    rows = _funcs(spark, sf).select("binary", "id", "name", "entry", F.col("complexity").alias("size"), "source")
    load = lambda v, m: F.struct(F.lit(v).cast("long").alias("vaddr"), F.lit(m).cast("long").alias("size"))
    kind = F.length("binary") % 6
    none = F.array().cast("array<struct<vaddr:bigint,size:bigint>>")
    loads = (
        F.when(kind == 0, none).when(kind == 1, F.array(load(0, C.MAX_SEGMENT + 1))).when(kind == 2, F.array(load(-16, 4096)))
        .when(kind == 3, F.array_repeat(load(0, C.MAX_SEGMENT), 3)).otherwise(F.array(load(0, 64)))
    )
    built = elf_build.files(rows, loads, F.when(kind == 4, 40).otherwise(elf.MACHINE_X86_64))
    return elf.split(materialize(elf.parse_files(built, strict=False), "elf"))[2]


def deduplicated_functions(spark: SparkSession, sf: str) -> DataFrame:
    """One function per binary and entry of all rows of ``funcs``, by the relational form of the rule."""
    rows = _funcs(spark, sf).select("binary", F.nullif("name", F.lit("")).alias("name"), "entry", F.col("complexity").alias("size"), "source")
    return elf.dedup_functions(rows).select("binary", "entry", "name")


def named_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the targets of calls: every entry of ``named`` called in every binary that it names."""
    calls = _table(spark, sf, "named").where("entry IS NOT NULL").select(F.col("from_binary").alias("binary"), F.col("entry").alias("target")).distinct()
    return elf.name_calls(calls, _funcs(spark, sf).select("binary", "name", "entry"))


def address_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of ``funcs`` (moved, so that some miss) looked up in the segments of their files."""
    asked = _funcs(spark, sf).select("id", "binary", (F.col("entry").bitwiseXOR(F.lit(0x4000))).alias("addr"))
    return elf.in_segments(asked, _read(spark, sf)[1]).select("id", "segment", "in_segment")


# ---- corpora ---------------------------------------------------------------------------------------------------------


def image_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of ``funcs`` written to images and read back, as an index of them shows them: every source is symtab."""
    return index.as_index(image.round_trip(_funcs(spark, sf))).select(*_FIELDS, _sig_md5())


def corpus_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A stored corpus that is filled by two appends, read back."""
    path = f"{work_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for part in _sides(spark, sf):
        corpus.append(spark, path, part.drop("id"))
    return corpus.Corpus.read(spark, path).funcs.select(*_FIELDS, _sig_md5())


def corpus_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Stored bands of a corpus that is filled by two appends: how many rows and keys each band has, and the corpus's size."""
    path = f"{work_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for part in _sides(spark, sf):
        corpus.append(spark, path, part.drop("id"))
    kept = corpus.Corpus.read(spark, path)
    return kept.stored.groupBy("band").agg(F.count("*").alias("n_rows"), F.count_distinct("key").alias("n_keys")).withColumn("functions", F.lit(kept.size()))


def stored_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown functions looked up in the stored band index, ungated and with all its dirt."""
    target, _ = _sides(spark, sf)
    return matching.stored_candidates(target.where(corpus.has_signal()), _funcs(spark, sf), _table(spark, sf, "bands"))


def ungated_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Per unknown function with enough signal how many rows share a band, whatever their signal or name."""
    target, _ = _sides(spark, sf)
    pairs = matching.candidates(target.where(corpus.has_signal()), _funcs(spark, sf))
    return pairs.groupBy("target_id").agg(F.count("*").alias("candidates"))


def checked_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a loader that refuses malformed signatures lets through, here all that have 128 slots."""
    return corpus.checked(_funcs(spark, sf).where(F.size("sig") == C.SLOTS)).select("id", _sig_md5())


def index_totals(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.index_summary(_funcs(spark, sf), None)


def known_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = _funcs(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    return rows.select("source", F.col("source").isin(*C.SOURCES).alias("known"), "n")


# ---- fingerprints ----------------------------------------------------------------------------------------------------


def trace_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of every single trace."""
    fp = fingerprint.fingerprints(_table(spark, sf, "traces"), "trace_id")
    return fp.select("trace_id", "complexity", "shingles", "capped", _sig_md5())


def trace_shingle_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Shingles of every trace that has effects, by column expressions; a digest of the sorted set."""
    tokens = F.transform(E.in_order(F.col("effects")), E.token)
    rows = _table(spark, sf, "traces").select("trace_id", F.array_sort(S.shingles(tokens)).alias("s")).where(F.size("s") > 0)
    return rows.select("trace_id", F.size("s").alias("n"), F.md5(F.array_join("s", ",")).alias("shingles_md5"))


def failed_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of the functions without a trace, taken as runs that couldn't be set up."""
    traced = _table(spark, sf, "traces").select(F.col("func_id").alias("id")).distinct()
    lost = _funcs(spark, sf).select("id").join(traced, "id", "left_anti").withColumnRenamed("id", "func_id")
    fp = fingerprint.fingerprints(index.failed_runs(lost))
    return fp.select("func_id", "complexity", "shingles", "capped", _sig_md5())


def streamed_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures from the running slots of the streaming form."""
    slots = ingest.assemble(ingest.running_slots(_table(spark, sf, "traces")))
    return slots.select("func_id", "complexity", "capped", _sig_md5())


def index_from_traces(spark: SparkSession, sf: str) -> DataFrame:
    """All functions with the fingerprints of their traces."""
    made = index.from_traces(_funcs(spark, sf).withColumnRenamed("id", "func_id"), _table(spark, sf, "traces"))
    return made.select("id", *_FIELDS, _sig_md5())


def index_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Functions found in files, those with code, each with the traces stored under its binary and entry."""
    functions, segments, _ = _read(spark, sf)
    owner = _funcs(spark, sf).select(F.col("id").alias("func_id"), "binary", "entry")
    stored = _table(spark, sf, "traces").select("func_id", "effects", "capped").join(owner, "func_id").drop("func_id")
    made = index.index_functions(functions, segments, index.traces_provider(stored))
    return made.select(*_FIELDS, _sig_md5())


def similarities(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of every row's signature to that of the first row of its binary with a signature of any length."""
    rows = _funcs(spark, sf).select("id", "binary", "sig")
    first = rows.groupBy("binary").agg(F.min_by("sig", F.when(F.size("sig") > 0, F.col("id"))).alias("first"))
    return rows.join(first, "binary").select("id", S.similarity(F.col("sig"), F.col("first")).alias("similarity"))


# ---- traces and logs -------------------------------------------------------------------------------------------------


def dump_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The traces of the first function of the commonest name."""
    funcs = _funcs(spark, sf)
    names = funcs.where("name <> ''").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name")
    top = names.first()
    return reports.dump(_table(spark, sf, "traces"), funcs, top["name"] if top else "")


_FAR = dict.fromkeys(("instructions", "visits", "effects", "reads", "heap_pages", "run_pages"), 1 << 30)
#: One cap at a time, low enough that runs of the log reach it.
TIGHT = {
    "instructions": {"instructions": 30}, "visits": {"visits": 2}, "effects": {"effects": 40}, "told": {"reads": 10, "heap_pages": 3}, "run_pages": {"run_pages": 9},
}


def log_effects_tight(spark: SparkSession, sf: str) -> DataFrame:
    """The effects of the runs under one cap at a time, each of which some runs reach."""
    log = _log(spark, sf)
    made = [access_log.effects_from_log(log, access_log.Caps(**(_FAR | caps))).withColumn("limit", F.lit(name)) for name, caps in TIGHT.items()]
    return reduce(DataFrame.unionByName, made)


def log_effects_uncapped(spark: SparkSession, sf: str) -> DataFrame:
    """All effects of the runs, up to more pages than the default allows."""
    return access_log.effects_from_log(_log(spark, sf), access_log.Caps(**_FAR))


def branch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf).withColumn("target", F.when(F.col("step") % 3 != 0, F.lit(0x400000) + (F.col("step") * 5) % 64))
    return access_log.branch_outcomes(log)


def exploration_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Per run and seed the natural path and the paths that turn one of the first two branches."""
    log = _log(spark, sf).withColumn("target", F.when(F.col("step") % 3 != 0, F.lit(0x400000) + (F.col("step") * 5) % 64))
    runs = log.select("run").distinct()
    made = access_log.plans(runs, access_log.branch_outcomes(log), 2)
    return made.select("run", "seed_ix", "path", F.array_join(F.transform("plan", lambda x: x.cast("string")), ",").alias("plan"))


MNEMONICS = ("call", "callq", "ret", "retq", "syscall", "sysenter", "int", "int3", "jmp", "jmpq", "je", "jne", "js", "mov", "nop", "lea")


def instruction_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of the instructions that the events stand for; every seventeenth can't be decoded."""
    k = (F.col("event_id") % (len(MNEMONICS) + 1)).cast("int")
    m = F.get(F.array(*map(F.lit, MNEMONICS)), k)
    rows = _table(spark, sf, "events").select(m.alias("mnemonic"))
    return rows.select("mnemonic", E.instruction_kind(F.col("mnemonic")).alias("kind")).groupBy("mnemonic", "kind").agg(F.count("*").alias("n"))


def _code(opcode: str, number: Column, n: int) -> Column:
    """Instruction bytes: an opcode and ``n`` little-endian bytes of a number."""
    digits = F.lpad(F.hex(number), 2 * n, "0")
    return F.unhex(F.concat(F.lit(opcode), *(F.substring(digits, 2 * (n - i) - 1, 2) for i in range(n))))


def jump_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of calls, short and near branches and of an indirect call, at addresses from the orders, some near the top."""
    k = F.col("o_orderkey").cast("long")
    addr = k * 4096 - 40_960
    rel = (k * 2_654_435_761) % (1 << 32)
    kind = k % 4
    code = F.when(kind == 0, _code("E8", rel, 4)).when(kind == 1, _code("75", rel % 256, 1)).when(kind == 2, _code("0F8F", rel, 4)).otherwise(F.unhex(F.lit("FFD0")))
    size = F.when(kind == 0, 5).when(kind == 2, 6).otherwise(2)
    rows = _table(spark, sf, "orders").select(k.alias("k"), addr.alias("addr"), size.alias("size"), code.alias("code"))
    args = [F.col(c) for c in ("addr", "size", "code")]
    return rows.select("k", E.call_target(*args).alias("call_target"), E.branch_target(*args).alias("branch_target"))


def register_results(spark: SparkSession, sf: str) -> DataFrame:
    """What skipped calls and system calls leave in the result register, for the counters of the events."""
    n = F.col("event_id").cast("long")
    return _table(spark, sf, "events").select(n.alias("counter"), E.call_result(n).alias("call_result"), E.syscall_result(n).alias("syscall_result"))


def page_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Words that unmapped pages are filled with, per seed."""
    base, word = F.col("o_orderkey").cast("long") * C.PAGE, (F.col("o_custkey") % 512).cast("int")
    rows = _table(spark, sf, "orders").select(base.alias("base"), word.alias("word"))
    return rows.select("base", "word", *(E.fill_word(F.col("base"), F.col("word"), s).alias(f"seed_{i}") for i, s in enumerate(C.SEEDS)))


def masked_values(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of values after they are cut to the size of their access."""
    v = F.col("o_orderkey").cast("long") * 37 - 5000
    size = F.get(F.array(*map(F.lit, (1, 2, 4, 8, 16))), (F.col("o_orderkey") % 5).cast("int"))
    c = E.classify_value(E.mask_to_size(v, size))
    return _table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k"), c["val"].alias("val"), c["val_k"].alias("val_k"))


def address_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of addresses around every border: arguments, stack, the binary's segments and the rest."""
    k = F.col("o_orderkey").cast("long")
    near = F.lit(C.ARG_BASE) + (k % 7) * F.lit(C.ARG_STRIDE) + (k * 13) % 40_000 - 3000
    stack = F.lit(C.STACK_BASE) + (k * 97) % 300_000 - 10_000
    addr = F.when(k % 3 == 0, near).when(k % 3 == 1, stack).otherwise(k * 4099 - 8000)
    place = E.classify_address(addr, k % 5 == 0)
    return _table(spark, sf, "orders").select(k.alias("k"), place["region"].alias("region"), place["region_k"].alias("region_k"), place["off"].alias("off"))


# ---- order of reports ------------------------------------------------------------------------------------------------


def query_order(spark: SparkSession, sf: str) -> DataFrame:
    return numbering.number_as_is(reports.query(*_sides(spark, sf)).select("id")).select("place", "id")


def triage_order(spark: SparkSession, sf: str) -> DataFrame:
    target, known = _sides(spark, sf)
    hits = reports.triage(target, _built(known, "-o0", "-o1"), _built(known, "-o2", "-o3"))
    return numbering.number_as_is(hits.select("id", "verdict")).select("place", "id", "verdict")


def match_order(spark: SparkSession, sf: str) -> DataFrame:
    """Changed names and names on one side only, each list in its order."""
    funcs = corpus.well_formed(_funcs(spark, sf))
    match = materialize(reports.match_by_name(_built(funcs, "-gx-"), _built(funcs, "-tc-", "-lv-")), "match")
    lists = {"changed": reports.match_changed(match, None), "only_a": reports.match_only(match, "a"), "only_b": reports.match_only(match, "b")}
    placed = [numbering.number_as_is(df.select("name")).select(F.lit(k).alias("list"), "place", "name") for k, df in lists.items()]
    return placed[0].unionByName(placed[1]).unionByName(placed[2])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__}
    return {k: f for k, f in own.items() if k[0] != "_" and k != "queries"}
