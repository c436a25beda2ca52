import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samples import BASE, EDIT, UNRELATED, effect, numbered, traces, write
from traceloom import constants as C
from traceloom.functions import effects as E
from traceloom.functions import hashing as H
from traceloom.functions import signature as S
from traceloom.operators import fingerprint as P

TOKENS = [
    (effect("new_region", region="arg", region_k=0), 6720671894399668445),
    (write("arg", 8, "input", 1, 0), -1815598387341510869),
    (write("arg", 16, "input", 1, 0), -1159114730496434493),
    (write("arg", -8, "small_const", -1, 0), 5921197462264452102),
    (effect("read", region="heapish", off=24), 7217034034735664441),
    (effect("call", sym="memcpy"), -2651337946658045712),
    (effect("call"), 591638443913531312),
    (effect("syscall", nr=1), 8746102329233966930),
    (effect("branch"), -5808596455572525216),
    (effect("ret", val="input", val_k=0), 5732173451021722135),
    (effect("ret", val="big_const"), 588744529308647635),
    (effect("capped"), -5808594256549268794),
    (effect("new_region", region="global"), 592600516588026712),
]


def test_golden_tokens_both_forms(spark):
    df = traces(spark, [(1, 1, numbered([e for e, _ in TOKENS]), False)])
    got = df.select(F.transform("effects", E.token).alias("t")).first().t
    assert got == [t for _, t in TOKENS]
    cols = [[e[k] for e, _ in TOKENS] for k in ("kind", "region", "region_k", "off", "val", "val_k", "sym", "nr")]
    ints = lambda a: np.array([x or 0 for x in a], np.int64)
    flat = [ints(c) if i in (2, 3, 5, 7) else E.Coded(pa.array(c, pa.string())) for i, c in enumerate(cols)]
    assert E.np_tokens(*flat).view(np.int64).tolist() == [t for _, t in TOKENS]


def test_golden_constants():
    assert H.py_fnv((1).to_bytes(8, "little") + bytes(8)) == 0x392209F14DEA4C24
    assert int(H.np_mix(3, np.array([1]), np.array([2]), np.array([3]), n=1)[0]) == 0xB981081392B03A26
    a, b = S.permutations()
    assert (int(a[0]), int(b[0])) == (0x9D8929916CA008E3, 0xE7037ED1A0B428DB)
    assert (int(a[127]), int(b[127])) == (0x38D00E91653F2F67, 0xA2FA48A7B66E8E80)


words = st.integers(-(1 << 63), (1 << 63) - 1)


def test_wrapping_arithmetic_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.tuples(words, words), min_size=20, max_size=40), words)
    def check(pairs, constant):
        k = constant & ((1 << 64) - 1)
        df = spark.createDataFrame(pairs, "x bigint, y bigint")
        cols = [H.wrap_add(F.col("x"), F.col("y")), H.wrap_mul(F.col("x"), k), H.wrap_mul(F.col("x"), F.col("y")), H.mix(F.col("x"), F.col("y"))]
        for (x, y), r in zip(pairs, df.select(*cols).collect()):
            mixed = H.py_fnv((x & (1 << 64) - 1).to_bytes(8, "little") + (y & (1 << 64) - 1).to_bytes(8, "little"))
            assert list(r) == [C.signed(x + y), C.signed(x * k), C.signed(x * y), C.signed(mixed)]

    check()


def test_minhash_tracks_jaccard():
    def sign(values):
        return S.np_minhash(np.array(values, np.uint64), np.array([0]), 1, np.array([0]))[0]

    assert (sign(range(200)) == sign(range(100, 300))).sum() == 34


def test_fixture_fingerprints(spark):
    df = traces(spark, [(1, 1, BASE, False), (2, 2, EDIT, False), (3, 3, UNRELATED, True), (4, 1, BASE, False)])
    fp = {r.func_id: r for r in P.fingerprints(df).collect()}
    base = fp[1]
    assert base.shingles == 22
    assert [x & (1 << 64) - 1 for x in base.sig[:4]] == [0x0213E9B3C7E9C0E4, 0x03E7B3830975857B, 0x022B325478480CA7, 0x008E9F635DF694AF]
    assert base.bands[0] & (1 << 64) - 1 == 0x33F703FEF1180AAC
    same = lambda i, j, f="sig": sum(x == y for x, y in zip(fp[i][f], fp[j][f]))
    assert (same(1, 2), same(1, 2, "bands")) == (82, 5)
    assert (same(1, 3), same(1, 3, "bands")) == (0, 0)
    assert fp[3].capped and not base.capped


def test_keys_with_many_effects_go_another_way_to_the_same_figures(spark, monkeypatch):
    rows = [(1, 1, BASE, False), (2, 1, EDIT, None), (3, 2, UNRELATED, True), (4, 3, [], False), (5, None, BASE, False), (6, 1, None, False), (7, 4, BASE[:2], False)]
    df = traces(spark, rows * 3)
    want = sorted(map(str, P.fingerprints(df).collect()))
    monkeypatch.setattr(P, "MANY_EFFECTS", 15)
    assert sorted(map(str, P.fingerprints(df).collect())) == want and len(want) == 5


def test_a_key_of_very_many_traces(spark, monkeypatch):
    monkeypatch.setattr(P, "MANY_EFFECTS", 50_000)
    one = F.struct(*(v.cast(t).alias(n) for n, t, v in [
        ("seq", "int", F.lit(0)), ("ic", "bigint", F.lit(0)), ("kind", "string", F.lit("syscall")), ("region", "string", F.lit(None)), ("region_k", "int", F.lit(None)), ("off", "int", F.lit(None)),
        ("val", "string", F.lit(None)), ("val_k", "bigint", F.lit(None)), ("sym", "string", F.lit(None)), ("nr", "bigint", F.col("id"))]))
    df = spark.range(120_000).select(F.lit(7).alias("func_id"), F.array(one).alias("effects"), (F.col("id") == 5).alias("capped"))
    r = P.fingerprints(df).first()
    values = H.np_mix(C.UNIGRAM, np.array([H.py_fnv(bytes([4]) + int(k).to_bytes(8, "little")) for k in range(120_000)], np.uint64), n=120_000)
    assert (r.shingles, r.complexity, r.capped) == (120_000, 3, True)
    assert r.sig == S.np_minhash(values, np.array([0]), 1, np.array([0]))[0].view(np.int64).tolist()


def test_empty_traces_are_zero_and_identical(spark):
    df = traces(spark, [(1, 1, [], False), (2, 2, None, None), (3, 3, numbered([effect("ret", val="zero")]), False), (4, 3, [], False)])
    fp = {r.func_id: r for r in P.fingerprints(df).collect()}
    assert fp[1].sig == fp[2].sig == [0] * 128 and fp[1].shingles == 0 and fp[1].capped is False
    assert {x & (1 << 64) - 1 for x in fp[1].bands} == {0x0C8210784D8AF5A5}
    assert fp[3].shingles == 1 and 0 not in fp[3].sig  # an empty part doesn't pull a slot to zero


def test_trigrams_start_at_three_tokens_and_never_span_traces(spark):
    e = [effect("branch"), effect("call"), effect("ret", val="zero")]
    rows = [(n, n, numbered(e[:n]), False) for n in (1, 2, 3)] + [(4, 9, numbered(e[:2]), False), (5, 9, numbered(e[2:]), False)]
    got = {r.func_id: r.shingles for r in P.fingerprints(traces(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 4, 9: 3}


def test_order_and_redelivery_inside_a_trace(spark):
    df = traces(spark, [(1, 1, BASE, False), (2, 2, BASE[::-1] + BASE[3:5], False)])
    fp = {r.func_id: r for r in P.fingerprints(df).collect()}
    assert fp[1].sig == fp[2].sig and fp[1].complexity == fp[2].complexity == 2 + 16 + 3 + 1
    by_col = df.select("func_id", E.complexity(E.in_order(F.col("effects"))).alias("c")).collect()
    assert {r.c for r in by_col} == {22}


def test_column_forms_equal_numpy(spark):
    df = traces(spark, [(1, 1, BASE, False), (2, 2, UNRELATED, False), (3, 3, numbered([effect("branch")]), False)])
    col = df.select("func_id", S.shingles(F.transform("effects", E.token)).alias("s"))
    fp = {r.func_id: r for r in P.fingerprints(df).collect()}
    assert {r.func_id: len(r.s) for r in col.collect()} == {k: r.shingles for k, r in fp.items()}
    keys = P.fingerprints(df).select("func_id", S.band_keys(F.col("sig")).alias("k")).collect()
    assert all(r.k == fp[r.func_id].bands for r in keys)


def test_signature_bytes_round_trip(spark):
    df = spark.createDataFrame([(1, [1, -1, 1 << 62]), (2, [])], "id int, sig array<bigint>")
    r = df.select(S.encode_signature(F.col("sig")).alias("b"), "sig").orderBy("id").collect()
    assert bytes(r[0].b) == b"".join(int(x).to_bytes(8, "little", signed=True) for x in r[0].sig)
    blob = spark.createDataFrame([(bytes(r[0].b) + b"\1\2\3",), (b"\1",), (None,)], "b binary")
    assert [x[0] for x in blob.select(S.decode_signature(F.col("b"))).collect()] == [[1, -1, 1 << 62], [], None]


def test_similarity_edges(spark):
    df = spark.createDataFrame([([1, 2], [1, 3]), ([1], [1, 2]), ([], []), (None, [1])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(S.similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0, 0.0]
