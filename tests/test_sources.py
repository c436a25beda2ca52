import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from samples import BASE, TRACES, UNRELATED, effect, func, funcs, numbered, sig, traces, write
from traceloom import __main__ as cli
from traceloom.constants import signed
from traceloom.functions import effects as E
from traceloom.functions import render
from traceloom.operators import corpus, fingerprint
from traceloom.plans import index, reports
from traceloom.sources import elf, elf_build, image
from traceloom.streaming import ingest


def build_elf(symbols=(), dynamic=(), loads=((0x401000, 0x2000),), eh=b"", machine=62):
    return elf_build.build(symbols, dynamic, loads, eh, machine)


def unwind(entry, size, eh_addr=0x500000):
    """A common record with pc-relative 32-bit pointers, a frame record, an unreadable one and an empty frame."""
    cie = struct.pack("<I", 0) + b"\1zR\0" + b"\1\x78\x10\1\x1b" + bytes(3)
    out = struct.pack("<I", len(cie)) + cie
    for e, s in ((entry, size), (entry + 64, 0)):
        here = len(out)
        out += struct.pack("<II", 16, here + 4) + struct.pack("<iI", e - (eh_addr + here + 8), s) + bytes(4)
    out += struct.pack("<II", 8, 9999) + bytes(4)
    return out + struct.pack("<I", 0)


FUNC, OBJECT = 2, 1


def test_symbols_dedup_and_order():
    data = build_elf(
        symbols=[("b", 0x401020, 8, FUNC), ("", 0x401010, 4, FUNC), ("data", 0x401030, 8, OBJECT), ("import", 0, 8, FUNC), ("empty", 0x401008, 0, FUNC), ("hi", (1 << 64) - 16, 4, FUNC)],
        dynamic=[("named", 0x401010, 4, FUNC), ("other", 0x401020, 8, FUNC)],
    )
    got = [(f["name"], f["entry"], f["source"]) for f in elf.parse(data).functions]
    assert got == [("named", 0x401010, "dynsym"), ("b", 0x401020, "symtab"), ("hi", -16, "symtab")]


def test_unwind_only_without_symbols():
    eh = unwind(0x401010, 12)
    got = elf.parse(build_elf(eh=eh)).functions
    assert [(f["name"], f["entry"], f["size"], f["source"]) for f in got] == [(None, 0x401010, 12, "eh_frame")]
    assert [f["source"] for f in elf.parse(build_elf(symbols=[("f", 0x401000, 4, FUNC)], eh=eh)).functions] == ["symtab"]


@pytest.mark.parametrize(
    "data",
    [
        b"", b"text, not a program", b"\x7fELF" + b"A" * 400, build_elf()[:60], build_elf(machine=40), build_elf(loads=[]),
        build_elf(loads=[(0x401000, (1 << 64) - 1)]), build_elf(loads=[(0x401000, (1 << 30) + 1)]), build_elf(loads=[((1 << 64) - 16, 4096)]),
        build_elf(loads=[(0x401000, 1 << 20)] * 20_000),
    ],
    ids=["empty", "text", "junk", "cut", "machine", "no load", "huge", "1 GiB + 1", "wraps", "many"],
)
def test_hostile_files_are_refused(data):
    with pytest.raises(elf.BadElf):
        elf.parse(data)


def test_offset_past_the_end_is_no_crash():
    data = bytearray(build_elf())
    struct.pack_into("<Q", data, 64 + 8, 1 << 60)
    s = elf.parse(bytes(data)).segments[0]
    assert s["bytes"] == b"" and s["mem_size"] == 0x2000


def test_holds_near_the_top(spark):
    rows = [(signed((1 << 64) - 8), 8, signed((1 << 64) - 4), 64), (signed((1 << 64) - 8), 8, -1, 16), (signed((1 << 64) - 8), 8, -1, 1), (0x401000, 64, 0x401040, 1), (0x401000, 64, 0x40103F, 1), (0x401000, 64, -5, 1), (5, 10, 4, 1)]
    df = spark.createDataFrame(rows, "v bigint, m bigint, e bigint, n bigint")
    got = [r[0] for r in df.select(F.when(F.col("n") == 1, elf.holds(F.col("v"), F.col("m"), F.col("e"))).when(F.col("n") == 16, elf.holds(F.col("v"), F.col("m"), F.col("e"), 16)).otherwise(elf.holds(F.col("v"), F.col("m"), F.col("e"), 64))).collect()]
    assert got == [False, False, True, False, True, False, False]


def test_read_files(spark, tmp_path):
    (tmp_path / "good.so").write_bytes(build_elf(symbols=[("f", 0x401000, 4, FUNC), ("out", 0x900000, 4, FUNC)]))
    (tmp_path / "bad.so").write_bytes(b"junk")
    functions, segments, errors = elf.read(spark, str(tmp_path), strict=False)
    assert {(r.binary, r.name) for r in functions.collect()} == {("good.so", "f"), ("good.so", "out")}
    assert [(r.binary, r.segment, r.mem_size, r.exec) for r in segments.collect()] == [("good.so", 0, 0x2000, True)]
    assert [r.binary for r in errors.collect()] == ["bad.so"]
    assert [r.name for r in elf.indexable(functions, segments).collect()] == ["f"]
    with pytest.raises(Exception, match="bad.so"):
        elf.read(spark, str(tmp_path))[0].collect()
    calls = spark.createDataFrame([("good.so", 0x401000), ("good.so", 5)], "binary string, target bigint")
    assert {r.target: r.sym for r in elf.name_calls(calls, functions).collect()} == {0x401000: "f", 5: None}
    twice = functions.union(functions.withColumn("source", F.lit("dynsym"))).union(functions.withColumn("name", F.lit(None).cast("string")))
    assert {(r.name, r.source) for r in elf.dedup_functions(twice).collect()} == {("f", "symtab"), ("out", "symtab")}

    def provider(found, _):
        made = found.select("func_id")
        rows = traces(spark, [(1, 1, BASE, False)]).select("effects", "capped")
        return made.crossJoin(rows)

    failed = index.failed_runs(spark.createDataFrame([(5,)], "func_id bigint"))
    assert failed.first().effects[0].kind == "capped" and failed.first().capped
    made = index.index_files(spark, str(tmp_path), provider, strict=False).collect()
    assert [(r.name, r.shingles, r.complexity) for r in made] == [("f", 22, 22)]


def record(seed, **over):
    return {"binary": "a.bin", "name": "foo", "entry": -2, "source": "dynsym", "complexity": 5, "shingles": 10, "capped": True, "sig": sig(seed)} | over


def test_image_round_trip(spark, tmp_path):
    (tmp_path / "c.db").write_bytes(image.build([record(3), record(999, name=None), record(5, binary="x" * ((1 << 20) + 1))]))
    got = {r.id: r for r in image.read(spark, str(tmp_path / "c.db")).collect()}
    assert set(got) == {1, 2} and got[1].sig == sig(3) and got[1].entry == -2 and got[1].capped is True and got[2].name is None
    assert {r.source for r in index.load_index(spark, str(tmp_path / "c.db")).collect()} == {"symtab"}
    parts = image.images(funcs(spark, [func(5, 3), func(2, 999)]).coalesce(1)).collect()
    assert [r["name"] for r in image.rows(bytes(parts[0].image))] == ["f", "f"] and parts[0].functions == 2


def test_images_of_a_partition_are_bounded(spark):
    """A partition of any size gives images of a bounded size, in order and whole; so do rows with long texts."""
    ids = spark.range(5000, numPartitions=1)
    slots = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.xxhash64("id", i))
    fields = {"binary": F.lit("b"), "name": F.concat(F.lit("f"), "id"), "entry": -F.col("id"), "source": F.lit("dynsym"), "complexity": F.lit(5), "shingles": F.col("id"), "capped": F.col("id") % 2 == 0, "sig": slots}
    df = ids.select("id", *(x.alias(c) for c, x in fields.items()))
    made = image.images(df).collect()
    assert len(made) > 2 and [r.piece for r in made] == list(range(len(made))) and sum(r.functions for r in made) == 5000
    assert max(len(r.image) for r in made) < 2 << 20
    assert [f["name"] for r in made for f in image.rows(bytes(r.image))] == [f"f{i}" for i in range(5000)]
    for back in (image.parse_images(image.images(df).select(F.col("image").alias("content"))), image.round_trip(df)):
        assert back.drop("id").exceptAll(df.drop("id")).isEmpty() and back.count() == 5000
    long = df.limit(20).withColumn("name", F.repeat(F.lit("x"), 1 << 20))
    assert [r.functions for r in image.images(long.coalesce(1)).collect()] == [1] * 20


def test_images_are_read_in_parts():
    """The reader holds a bounded number of functions, whatever the image's size."""
    whole = image.build([record(k) for k in range(1, 5001)])
    sizes = [len(part) for part in image._read(whole)]
    assert sum(sizes) == 5000 and max(sizes) <= 2000
    long = image.build([record(k, name="x" * (1 << 20)) for k in range(1, 21)])
    assert max(len(part) for part in image._read(long)) <= 8


def test_bad_images():
    for bad in (b"", bytes.fromhex("deadbeef00010203"), b"SQLite format 3\0" + b"\1" * 600):
        with pytest.raises(image.BadImage):
            image.rows(bad)
    con = sqlite3.connect(":memory:")
    con.executescript(image.DDL)
    for blob in (bytes(7), bytes(4096), "text" * 256):
        con.execute("INSERT INTO funcs(binary, entry, source, complexity, shingles, capped, sig) VALUES('b', 0, 's', 1, 1, 0, ?)", (blob,))
    con.commit()
    assert image.rows(bytes(con.serialize())) == []


def test_escape(spark):
    rows = [("foo\x1b[31mbar",), ("a\nb\r",), ("adler32_z",), ("é",), ("",), (None,), ("~ \x7f",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(render.escape(F.col("s"))).collect()]
    assert got == ["foo\\x1b[31mbar", "a\\x0ab\\x0d", "adler32_z", "\\xc3\\xa9", "", None, "~ \\x7f"]
    df = spark.createDataFrame([(0x401000,), (-1,), (1 << 36,)], "e bigint")
    assert [r[0] for r in df.select(render.hex_entry(F.col("e"))).collect()] == ["0x00401000", "0xffffffffffffffff", "0x1000000000"]


def test_dump(spark):
    f = funcs(spark, [func(2, 3, "main", entry=50), func(1, 3, "main", entry=10), func(3, 3, "x")])
    t = traces(spark, [(1, 1, BASE[:2] + BASE[9:], False), (2, 2, BASE, False)]).withColumns({"seed_ix": F.lit(0), "instret": F.lit(7).cast("long")})
    lines = [r.line for r in reports.dump(t, f, "main").orderBy("path", "line_no").collect()]
    assert lines == [
        "-- path 0 (5 effects, instret 7, capped false) --",
        "   NewRegion(Arg(0))",
        "   Write { region: Arg(0), off: 0, val: Input(0) }",
        '   Call(Sym("memcpy"))',
        "   Branch",
        "   Ret(Input(0))",
    ]
    assert reports.dump(t, f, "nobody").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from traceloom.operators.fingerprint import fingerprints

    rows = [(1, 1, BASE, False), (2, 1, BASE[5:], True), (3, 2, BASE[:3], False), (4, 2, None, False), (1, 1, BASE, False)]
    for i, r in enumerate(rows):
        traces(spark, [r]).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(traces(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = ingest.running_slots(stream).writeStream.outputMode("complete").format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.func_id: (r.sig, r.complexity, r.capped) for r in ingest.assemble(spark.table("slots")).collect()}
    want = {r.func_id: (r.sig, r.complexity, r.capped) for r in fingerprints(traces(spark, rows)).collect()}
    assert got == want and TRACES


def test_command_line(spark, tmp_path, capsys):
    one, two = [func(1, 3, "f\x1b"), func(2, 999, "g"), func(3, 999, "h")], [func(1, 3, "f\x1b"), func(2, 3, "k", binary="z")]
    seeded = {"seed_ix": F.lit(0), "instret": F.lit(1)}
    for name, rows, made in (("one", one, [(1, 1, BASE, False), (2, 2, BASE[:4], False), (3, 3, UNRELATED, False)]), ("two", two, [(1, 1, BASE, False), (2, 2, UNRELATED, False)])):
        funcs(spark, rows).write.parquet(str(tmp_path / name / "functions"))
        traces(spark, made).withColumns(seeded).write.parquet(str(tmp_path / name / "traces"))
    at = lambda *x: str(tmp_path.joinpath(*x))
    f, t, c = at("one", "functions"), at("one", "traces"), at("corpus")
    cli.main(["index", f, t, "-o", c])
    cli.main(["index", at("two", "functions"), at("two", "traces"), "-o", c, "--binary", "second"])
    kept = corpus.Corpus.read(spark, c)
    assert sorted((r.binary, r.name) for r in kept.funcs.collect()) == [("b", "f\x1b"), ("b", "g"), ("b", "h"), ("second", "f\x1b"), ("second", "k")]
    assert kept.size() == kept.funcs.select("id").distinct().count() == 5 and not kept.is_empty()
    assert kept.stored.count() == 5 * 32 and corpus.missing_bands(kept.funcs, kept.stored).count() == corpus.stale_bands(kept.funcs, kept.stored).count() == 0
    cli.main(["index", f, t, "-o", at("other")])
    cli.main(["match", at("other"), c])
    cli.main(["query", at("other"), "--corpus", c])
    cli.main(["query", at("other"), "--corpus", c, "--threshold", "1.5"])
    cli.main(["eval", at("other"), c])
    cli.main(["triage", at("other"), "--vuln", c, "--patched", c])
    cli.main(["dump", f, t, "g"])
    out = capsys.readouterr().out
    for text in ("indexed 3: 3 with a name", "appended 3 to", "appended 2 to", "compared: 3 (same 3", "only in " + c + ": 1", "100.0%  f\\x1b  (b)", "reaches 1.50", "rank1_accuracy: ", "inconclusive: 3", "NewRegion(Arg(0))"):
        assert text in out, text
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "own.so").write_bytes(build_elf(symbols=[("f", 0x401000, 4, FUNC), ("g", 0x401010, 4, FUNC)]))
    stored = traces(spark, [(1, 1, BASE, False)]).select(F.lit("own.so").alias("binary"), F.lit(0x401000).cast("long").alias("entry"), "effects", "capped")
    stored.write.parquet(at("stored"))
    cli.main(["index", at("bin"), at("stored"), "-o", at("fresh")])
    assert [(r.binary, r.name, r.shingles) for r in corpus.Corpus.read(spark, at("fresh")).funcs.collect()] == [("own.so", "f", 22)]


def test_index_from_an_access_log(spark):
    data = build_elf(symbols=[("f", 0x401000, 4, FUNC), ("g", 0x401010, 4, FUNC)])
    functions, segments, _ = elf.split(elf.parse_files(spark.createDataFrame([("x/own.so", data)], "path string, content binary")))
    ddl = "binary string, entry bigint, seed_ix int, step bigint, event string, instret bigint, addr bigint, size int, value bigint, insn string, target bigint, nr bigint"
    rows = [("own.so", 0x401000, s, *x) for s in (0, 1) for x in [(0, "insn", 1, 0x401000, 8, 0, "call", 0x401010, None), (1, "write", 1, 0x401100, 8, 0, None, None, None), (2, "write", 1, 0x70000000, 8, 5, None, None, None), (3, "insn", 2, 0x401004, 8, 0, "call", 0x999, None)]]
    rows += [("other.so", 0x401000, 0, 0, "insn", 1, 0, 8, 0, "plain", None, None), ("own.so", 0x401010, 0, 0, "insn", 1, 0, 8, 0, "plain", None, None)]
    got = {r.name: r for r in index.index_functions(functions, segments, index.log_provider(spark.createDataFrame(rows, ddl))).collect()}
    assert set(got) == {"f", "g"} and got["g"].shingles == 0
    told = numbered([effect("call", sym="g"), effect("new_region", region="global"), write("global", 0, "zero"), effect("new_region", region="heapish"), write("heapish", 0, "small_const", 5), effect("call")])
    assert got["f"].sig == fingerprint.fingerprints(traces(spark, [(1, 1, told, False)])).first().sig


def test_instruction_columns(spark):
    rows = [("call", 0x401000, 5, bytes.fromhex("e8fb000000")), ("callq", -3, 5, bytes.fromhex("e800000000")), ("call", 16, 2, bytes.fromhex("ffd0")), ("jne", 100, 2, bytes.fromhex("75fe")), ("jmp", 100, 2, bytes.fromhex("ebfe")), ("jg", 100, 6, bytes.fromhex("0f8f00000080")), ("int3", 0, 1, b"\xcc"), ("int", 0, 2, b"\xcd\x80"), ("retq", 0, 1, b"\xc3"), (None, 0, 1, b"")]
    df = spark.createDataFrame(rows, "m string, a bigint, n int, code binary")
    got = df.select(E.instruction_kind(F.col("m")).alias("k"), E.call_target(F.col("a"), F.col("n"), F.col("code")).alias("c"), E.branch_target(F.col("a"), F.col("n"), F.col("code")).alias("b")).collect()
    assert [r.k for r in got] == ["call", "call", "call", "branch", "plain", "branch", "plain", "syscall", "ret", "plain"]
    assert [r.c for r in got[:3]] == [0x401100, 2, None]
    assert [r.b for r in got[3:6]] == [100, None, 106 - (1 << 31)]
