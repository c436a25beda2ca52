import pytest
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.constants import signed
from traceloom.functions import effects as E
from traceloom.operators import access_log as A
from traceloom.operators import eager

ARG = [E.arg_base(k) for k in range(6)]
HEAP = 0x7000_0000


def log(spark, rows, run=1):
    """rows: (event, fields); instructions count themselves."""
    out, n = [], 0
    for step, (event, over) in enumerate(rows):
        n += event == "insn"
        d = {"addr": 0, "size": 8, "value": 0, "in_segment": False, "insn": "plain" if event == "insn" else None, "sym": None, "nr": None} | over
        out.append((run, step, event, n, *(d[k] for k in ("addr", "size", "value", "in_segment", "insn", "sym", "nr"))))
    return spark.createDataFrame(out, A.LOG)


def shown(df):
    return [(r.kind, r.region, r.off, r.val) for r in df.orderBy("run", "seq").collect()]


def test_value_classes(spark):
    cases = {0: "zero", ARG[2]: "input", ARG[5] + 1: "input_deriv", ARG[0] + C.ARG_SIZE: "big_const", 4096: "small_const", -4096: "small_const", 4097: "big_const", -4097: "big_const", -(1 << 63): "big_const"}
    df = spark.createDataFrame([(k,) for k in cases], "v bigint")
    assert [r.c.val for r in df.select(E.classify_value(F.col("v")).alias("c")).collect()] == list(cases.values())
    sizes = spark.createDataFrame([(-1, 1), (-1, 2), (-1, 4), (-1, 8), (-1, 16)], "v bigint, n int")
    got = sizes.select(E.classify_value(E.mask_to_size(F.col("v"), F.col("n"))).alias("c")).collect()
    assert [(r.c.val, r.c.val_k) for r in got] == [("small_const", 255), ("big_const", None), ("big_const", None), ("small_const", -1), ("small_const", -1)]


def test_addresses_and_offsets(spark):
    rows = [(ARG[1] + 9, False), (C.STACK_START - 8, False), (C.STACK_BASE, False), (0x400000, True), (0x400123, False), (signed((1 << 64) - 1), False), (None, False)]
    got = [r.p for r in spark.createDataFrame(rows, "a bigint, s boolean").select(E.classify_address(F.col("a"), F.col("s")).alias("p")).collect()]
    assert [p and (p.region, p.region_k, p.off) for p in got] == [("arg", 1, 9), ("stack", None, -8), ("stack", None, -0x20000), ("global", None, 0), ("heapish", None, 0x123), ("heapish", None, 0xFFF), None]
    off = spark.createDataFrame([(x,) for x in (-7, -9, 7, 8, 2055, 2048, -5000, 0)], "o bigint")
    assert [r[0] for r in off.select(E.bucket_offset(F.col("o"))).collect()] == [0, -8, 0, 8, 2048, 2048, -2048, 0]


def test_effects_in_order(spark):
    rows = [("insn", {"addr": 1}), ("write", {"addr": ARG[0], "value": ARG[1]}), ("insn", {"addr": 2, "insn": "call", "sym": "do_thing"}), ("write", {"addr": C.STACK_START}), ("read", {"addr": 0x400000, "in_segment": True}), ("read", {"addr": 0x400100, "in_segment": True}), ("insn", {"addr": 3, "insn": "syscall", "nr": -1}), ("insn", {"addr": 4, "insn": "branch"}), ("insn", {"addr": 5, "insn": "ret", "value": ARG[0]})]
    got = A.effects_from_log(log(spark, rows)).orderBy("seq").collect()
    assert [(r.kind, r.region, r.val) for r in got] == [("new_region", "arg", None), ("write", "arg", "input"), ("call", None, None), ("new_region", "global", None), ("read", "global", None), ("syscall", None, None), ("branch", None, None), ("ret", None, "input")]
    assert [r.seq for r in got] == list(range(8)) and got[2].sym == "do_thing" and got[5].nr == 0xFFFFFFFF and got[-1].ic == 5


def test_reads_past_the_64th_field_are_remembered_not_told(spark):
    reads = [("read", {"addr": ARG[k // 40] + 8 * (k % 40)}) for k in range(65)]
    rows = A.read_footprint(A.with_regions(log(spark, reads + reads[-1:] + reads[:1])))
    assert rows.where("field_read").count() == 64 and rows.where("field_read").agg(F.max("step")).first()[0] == 63


def test_heap_pages_past_the_24th_are_not_told(spark):
    rows = [("read", {"addr": HEAP + C.PAGE * k}) for k in range(25)] + [("read", {"addr": ARG[0]}), ("read", {"addr": HEAP + C.PAGE * 24 + 8}), ("read", {"addr": ARG[0] + 8})]
    told = A.first_touches(log(spark, rows)).where("touched")
    assert [r.step for r in told.orderBy("step").collect()] == [*range(24), 25]


def test_caps(spark):
    caps = A.Caps(effects=32)
    flood = [("insn", {"addr": 1})] + [("write", {"addr": ARG[0] + 8 * k}) for k in range(200)]
    got = shown(A.effects_from_log(log(spark, flood), caps))
    assert len(got) == 33 and got[-1][0] == "capped"
    # reads have no check of their own, so an instruction can go past the bound
    reads = [("insn", {"addr": 1})] + [("read", {"addr": ARG[0] + 8 * k}) for k in range(40)] + [("insn", {"addr": 2, "insn": "branch"})]
    got = shown(A.effects_from_log(log(spark, reads), caps))
    assert len(got) == 42 and got[-1][0] == "capped" and got[-2][0] == "read"
    loop = [("insn", {"addr": 1, "insn": "branch"})] * 70
    got = shown(A.effects_from_log(log(spark, loop)))
    assert len(got) == 65 and got[-1][0] == "capped"
    idle = [("insn", {"addr": k}) for k in range(5)]
    assert shown(A.effects_from_log(log(spark, idle), A.Caps(instructions=3)))[-1][0] == "capped"
    assert shown(A.effects_from_log(log(spark, idle))) == []
    pages = [("insn", {"addr": 1})] + [("read", {"addr": HEAP + C.PAGE * k}) for k in range(10)]
    got = shown(A.effects_from_log(log(spark, pages), A.Caps(run_pages=3)))
    assert [k for k, *_ in got].count("read") == 1 and [k for k, *_ in got].count("new_region") == 3


def test_branch_outcomes_and_plans(spark):
    rows = [("insn", {"addr": 1, "insn": "branch"}), ("insn", {"addr": 9}), ("insn", {"addr": 2, "insn": "branch"}), ("insn", {"addr": 3}), ("insn", {"addr": 4, "insn": "branch"})]
    seen = A.branch_outcomes(log(spark, rows).withColumn("target", F.lit(9).cast("long")))
    assert [(r.step, r.taken) for r in seen.orderBy("step").collect()] == [(0, True), (2, False)]
    runs = spark.createDataFrame([(1,), (2,)], "run bigint")
    assert A.plans(runs, seen, 0).count() == 8
    deep = {(r.run, r.path): r.plan for r in A.plans(runs, seen, 5).where("seed_ix = 0").collect()}
    assert deep == {(1, 0): [], (1, 1): [False], (1, 2): [True, True], (2, 0): []}


def test_fill_words(spark):
    def want(base, word, seed):
        m = (1 << 64) - 1
        x = (base + 8 * word + seed * C.GOLDEN) & m
        x = ((x ^ x >> 30) * C.FILL_MUL_1) & m
        x = ((x ^ x >> 27) * C.FILL_MUL_2) & m
        return signed(x ^ x >> 31)

    df = spark.createDataFrame([(ARG[k % 6], k) for k in range(8)], "b bigint, w int")
    for seed in C.SEEDS:
        assert [r[0] for r in df.select(E.fill_word(F.col("b"), F.col("w"), seed)).collect()] == [want(ARG[k % 6], k, seed) for k in range(8)]
    assert df.select(E.call_result(F.col("w"))).collect()[1][0] == signed(C.CALL_RESULT ^ C.GOLDEN)
    assert df.select(E.syscall_result(F.col("w"))).collect()[3][0] == C.SYSCALL_RESULT ^ 3


def test_eager_join_equals_plain_join(spark):
    left = spark.createDataFrame([(k % 5 if k % 7 else None, f"g{k % 3}", k if k % 4 else None, "x") for k in range(80)] * 2, "k int, g string, v int, extra string")
    right = spark.createDataFrame([(0 if k % 3 else k % 6, f"h{k % 2}", k * 10, "y") for k in range(60)], "k int, h string, w int, extra string")
    one = eager.Side(left, ["g"], {"v": F.col("v")}, {"lo": F.col("v")}, {"hi": F.col("v")})
    fast = eager.eager_join_aggregate(one, eager.Side(right, ["h"], {"w": F.col("w")}), ["k"], ["g", "h"])
    cols = [F.count("*").alias("n_rows"), F.sum("v").alias("v"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("w")]
    plain = left.drop("extra").join(right.drop("extra"), "k").groupBy("g", "h").agg(*cols)
    assert sorted(fast.drop("left_rows", "right_rows").select(plain.columns).collect()) == sorted(plain.collect())
    assert eager.eager_join_aggregate(eager.Side(left.limit(0)), eager.Side(right), ["k"]).count() == 0
    counted = eager.eager_join_aggregate(eager.Side(left, distinct="g"), eager.Side(right, distinct="h", distinct_as="n_h"), ["k"])
    want = left.join(right.select("k", "h"), "k").groupBy("k").agg(F.count("*").alias("n_rows"), F.count_distinct("g").alias("n_distinct"), F.count_distinct("h").alias("n_h"))
    assert sorted(counted.select(want.columns).collect()) == sorted(want.collect())
    per = {r.k: (r.left_rows, r.right_rows) for r in counted.collect()}
    assert per == {k: (left.where(f"k = {k}").count(), right.where(f"k = {k}").count()) for k in per}
    with pytest.raises(ValueError):
        eager.eager_join_aggregate(eager.Side(left, ["g"], distinct="v"), eager.Side(right), ["k"], ["g"])


def test_value_profile(spark):
    s, t = list(range(128)), [7] * 128
    rows = [(1, "a", "n", 0, 2, s, "2024-01-01"), (2, "a", None, 0, None, s, "2024-01-03"), (3, None, "", 0, 2, t, "2024-01-02"), (4, "b", "n", None, 2, [1], None), (4, "b", "n", None, 2, None, None)]
    df = spark.createDataFrame(rows, "id bigint, binary string, name string, complexity bigint, shingles bigint, sig array<bigint>, indexed_at string")
    got = {(r.field, r.key_text): tuple(r)[2:] for r in eager.value_profile(df.withColumn("k1", F.lit(1)).withColumn("field", F.lit("x"))).collect()}
    assert got == {
        ("complexity", "0"): (3, 1, 2, "2024-01-01", "2024-01-03"), ("shingles", "2"): (4, 2, 2, "2024-01-01", "2024-01-02"),
        ("sig", "1"): (2, 1, 1, "2024-01-01", "2024-01-03"), ("sig", "3"): (1, 0, 1, "2024-01-02", "2024-01-02"),
    }
    assert {(r.field, r.key_text) for r in eager.heavy_values(df, 0.5).collect()} == {("complexity", "0"), ("shingles", "2")}
    assert eager.value_profile(df.limit(0)).count() == 0 and eager.heavy_values(df.limit(0)).count() == 0
