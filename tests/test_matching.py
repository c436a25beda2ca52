import pytest
from pyspark.sql import functions as F

from samples import func, funcs, sig
from traceloom.operators import corpus as K
from traceloom.operators import matching as M
from traceloom.plans import reports as R


def slots(n, other=1 << 40):
    """A signature that agrees with sig(3) in the last n slots; slot 0 differs."""
    base = sig(3)
    return [base[i] if i >= 128 - n else other + i for i in range(128)]


def test_match_statuses(spark):
    a = funcs(spark, [func(1, 3, "same"), func(2, 3, "changed"), func(3, 3, "weak", complexity=2), func(4, 3, "a"), func(5, 3, None), func(6, 9, "dup"), func(7, 3, "dup")])
    b = funcs(spark, [func(1, 3, "same"), func(2, 999, "changed"), func(3, 999, "weak"), func(4, 3, "b"), func(5, 7, "dup"), func(6, 3, "dup")])
    m = R.match_by_name(a, b)
    got = {r.name: (r.status, r.similarity) for r in m.collect()}
    assert got == {
        "same": ("same", 1.0), "changed": ("changed", 1 / 128), "weak": ("low_signal", None), "a": ("only_a", None), "b": ("only_b", None), "dup": ("same", 1.0),
    }
    assert R.match_summary(m).first().asDict() == {"compared": 4, "same": 2, "changed": 1, "low_signal": 1, "only_a": 1, "only_b": 1}
    assert [r.name for r in R.match_changed(m).collect()] == ["changed"]
    assert [r.name for r in R.match_only(m, "a").collect()] == ["a"]


def test_same_threshold_is_113_slots(spark):
    a = funcs(spark, [func(1, 0, "x", slots=slots(113)), func(2, 0, "y", slots=slots(112))])
    b = funcs(spark, [func(1, 3, "x"), func(2, 3, "y")])
    assert {r.name: r.status for r in R.match_by_name(a, b).collect()} == {"x": "same", "y": "changed"}


def test_hot_buckets_are_passed_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(60) for _ in range(128)]

    def like(edits, keep=8):
        out = list(base)
        for i in rng.sample(range(keep, 128), edits):
            out[i] = rng.getrandbits(60)
        return out

    target = [func(i, 0, None, slots=like(rng.choice([2, 20, 60, 118]))) for i in range(60)] + [func(90 + i, 0, None, slots=[rng.getrandbits(60) for _ in range(128)]) for i in range(3)]
    known = [func(i, 0, f"n{i}", slots=like(rng.choice([2, 20, 60, 118]))) for i in range(60)] + [func(100 + i, 0, f"n{i}", slots=target[i][-1]) for i in range(5)]
    t, k = funcs(spark, target), funcs(spark, known)
    want = sorted(map(str, M.best_match(t, k).collect()))
    monkeypatch.setattr(M, "HOT_BUCKET", 5)
    assert M.seek(t).hot is not None
    assert sorted(map(str, M.best_match(t, k).collect())) == want and len(want) == 63


def test_bands_compare_band_by_band(spark):
    # four equal slots in another band give the same key but no candidate
    run = [11, 12, 13, 14]
    x = funcs(spark, [func(1, 0, slots=run + list(range(1000, 1124)))])
    y = funcs(spark, [func(2, 0, slots=list(range(2000, 2004)) + run + list(range(3000, 3120)))])
    keys = {r.func_id: r for r in K.derive_bands(x.union(y)).where("(func_id = 1 AND band = 0) OR (func_id = 2 AND band = 1)").collect()}
    assert keys[1].key == keys[2].key
    assert M.candidates(x, y).count() == 0
    assert {(r.target_id, r.func_id) for r in M.candidates(x, x.union(y)).collect()} == {(1, 1)}


def best(spark, target, corpus):
    return {r.id: r for r in M.best_match(funcs(spark, target), funcs(spark, corpus)).collect()}


def test_fallback_only_without_any_candidate(spark):
    # a candidate that fails the gate means no match, not a scan
    got = best(spark, [func(1, 3)], [func(5, 3, "weak", complexity=3), func(6, 999, "far")])
    assert got == {}
    got = best(spark, [func(1, 3)], [func(5, 3, None), func(6, 999, "far")])
    assert got == {}
    got = best(spark, [func(1, 55555)], [func(6, 999, "far"), func(7, 3, "far too")])
    assert (got[1].guess, got[1].similarity) == ("far", 1 / 128)


def test_nothing_agrees(spark):
    got = best(spark, [func(1, 0, slots=[-5 - i for i in range(128)])], [func(9, 3, "b"), func(8, 3, "a"), func(7, 3, None)])
    assert (got[1].guess, got[1].similarity, got[1].func_id) == ("a", 0.0, 8)
    assert best(spark, [func(1, 3)], [func(2, 3, None)]) == {}
    assert best(spark, [func(1, 3)], []) == {}


def test_ties_gates_and_copies(spark):
    corpus = [func(9, 3, "late"), func(4, 3, "early"), func(2, 3, None), func(1, 3, "weak", complexity=3)]
    got = best(spark, [func(1, 3), func(2, 3), func(3, 3, complexity=3), func(4, 3, shingles=0), func(5, 0, slots=[1, 2])], corpus)
    assert {k: r.guess for k, r in got.items()} == {1: "early", 2: "early"}


def test_query_threshold_is_90_slots(spark):
    t = funcs(spark, [func(1, 0, slots=slots(90), entry=16), func(2, 0, slots=slots(89)), func(3, 3, entry=-1), func(4, 3, entry=5)])
    got = R.query(t, funcs(spark, [func(7, 3, "g", binary="bin")])).collect()
    assert [(r.id, r.similarity) for r in got] == [(4, 1.0), (3, 1.0), (1, 90 / 128)]  # negative entries are high addresses


def test_triage(spark):
    vuln, patched = funcs(spark, [func(1, 3, "v")]), funcs(spark, [func(1, 999, "p")])
    t = funcs(spark, [func(1, 3), func(2, 999), func(3, 55555), func(4, 3, complexity=1)])
    hits = R.triage(t, vuln, patched, 0.5, 0.1)
    assert [(r.id, r.verdict) for r in hits.collect()] == [(1, "vulnerable"), (3, "inconclusive"), (2, "patched")]
    assert R.triage_counts(hits).first().asDict() == {"triaged": 3, "vulnerable": 1, "patched": 1, "inconclusive": 1}
    assert [r.id for r in R.review_queue(hits).collect()] == [1]
    none = R.triage(t, funcs(spark, []), patched, 0.5, 0.1).where("id = 1").first()
    assert (none.vuln_similarity, none.vuln_name) == (0.0, "")


@pytest.mark.parametrize(
    ("v", "p", "least", "margin", "want"),
    [
        (76, 0, 0.6, 0.08, "inconclusive"), (77, 0, 0.6, 0.08, "vulnerable"), (0, 77, 0.6, 0.08, "patched"),
        (100, 90, 0.6, 0.08, "inconclusive"), (100, 89, 0.6, 0.08, "vulnerable"), (100, 100, 0.6, 0.0, "vulnerable"), (116, 100, 0.6, 0.125, "vulnerable"),
    ],
)
def test_verdict_edges(spark, v, p, least, margin, want):
    df = spark.createDataFrame([(v / 128, p / 128)], "v double, p double")
    assert df.select(R.verdict(F.col("v"), F.col("p"), least, margin)).first()[0] == want


def brute_eval(a, b):
    gate = lambda f: f[5] >= 4 and f[6] > 0 and f[2] is not None and len(f[8]) == 128
    b, out = [f for f in b if gate(f)], {}
    for f in a:
        if gate(f) and any(g[2] == f[2] for g in b):
            ranked = sorted(b, key=lambda g: (-sum(x == y for x, y in zip(f[8], g[8])), g[0]))
            top = ranked[0]
            out[f[0]] = (next(i for i, g in enumerate(ranked) if g[2] == f[2]) + 1, top[2], sum(x == y for x, y in zip(f[8], top[8])) / 128)
    return out


def test_evaluate(spark):
    alone = [-7 - i for i in range(128)]
    a = [func(1, 3, "x"), func(2, 999, "y"), func(3, 7, "missing"), func(4, 0, "x", slots=alone), func(5, 0, "z", slots=slots(60)), func(6, 3, None), func(7, 3, "x", complexity=2), func(8, 3, "w")]
    b = [func(11, 3, "w"), func(12, 3, "x"), func(13, 7, "y"), func(14, 5, "x"), func(15, 0, "z", slots=slots(100, 1 << 41)), func(16, 3, "q", shingles=0)]
    ranks = R.evaluate_ranks(funcs(spark, a), funcs(spark, b))
    got = {r.id: (r.rank, r.top_name, r.top_similarity) for r in ranks.collect()}
    assert got == brute_eval(a, b)
    e = R.evaluate(ranks).first()
    assert (e.scored, e.rank1, e.tp, e.fp, e.fn, e.abstained) == (5, 1, 1, 1, 0, 3)
    assert e.precision == 0.5 and e.recall == 1.0 and e.recall_at_5 == 1.0
    empty = R.evaluate(R.evaluate_ranks(funcs(spark, []), funcs(spark, b))).first()
    assert (empty.scored, empty.mrr, empty.precision, empty.abstain_rate) == (0, 0.0, 0.0, 0.0)


def test_corpus_store(spark, tmp_path):
    rows = [func(1, 0, "foo"), func(2, 999, "bar"), func(3, 1, "long", binary="x" * ((1 << 20) + 1)), func(4, 1, slots=[1, 2]), func(5, 1, slots=None, name="n")]
    rows.append((6, None, "nobin", 0, "symtab", 5, 5, False, sig(1)))
    c = K.Corpus.of(funcs(spark, rows))
    assert {r.id for r in c.funcs.collect()} == {1, 2, 5}
    c.write(str(tmp_path / "c"))
    again = K.Corpus.read(spark, str(tmp_path / "c"))
    assert again.funcs.count() == 3 and again.bands.count() == 96
    K.append(spark, str(tmp_path / "c"), funcs(spark, [func(0, 3, "new"), func(0, 3, "new")]).drop("id"))
    grown = spark.read.parquet(str(tmp_path / "c" / "funcs"))
    assert grown.count() == 5 and grown.select("id").distinct().count() == 5 and grown.where("name = 'new'").agg(F.min("id")).first()[0] > 5
    assert spark.read.parquet(str(tmp_path / "c" / "bands")).count() == 160
    K.append(spark, str(tmp_path / "fresh"), funcs(spark, [func(0, 3)]).drop("id"))
    assert spark.read.parquet(str(tmp_path / "fresh" / "funcs")).count() == 1
    with pytest.raises(Exception, match="wrong length"):
        K.checked(funcs(spark, rows)).select("sig").collect()
    s = K.index_summary(funcs(spark, rows), None).first()
    assert (s.functions, s.named, s.usable) == (6, 6, 6)


def test_stale_and_missing_bands(spark):
    f = funcs(spark, [func(1, 3)])
    good = K.derive_bands(f)
    stored = good.where("band > 1").union(good.where("band = 2")).union(spark.createDataFrame([(1, 0, 5), (77, 1, 9)], "func_id bigint, band int, key bigint"))
    assert {(r.func_id, r.band) for r in K.stale_bands(f, stored).collect()} == {(1, 0), (77, 1)}
    assert {r.band for r in K.missing_bands(f, stored).collect()} == {0, 1}


def test_blocks_and_shares(spark):
    import random

    from traceloom.operators.blocks import against_all

    rng = random.Random(1)
    sigs = lambda n: [[rng.randrange(3) for _ in range(128)] for _ in range(n)]
    qs, rs = sigs(30), sigs(70)
    rs[5] = rs[6] = qs[3]
    queries = [(i, s, rng.randrange(30, 60), rng.randrange(100)) for i, s in enumerate(qs)]
    rows = [(i * 2 - 20, s) for i, s in enumerate(rs)]
    got = against_all(
        spark.createDataFrame(queries, "q bigint, sig array<bigint>, bar int, bar_place bigint"), spark.createDataFrame(rows, "place bigint, sig array<bigint>"), 7, 20
    )
    want = {}
    for q, s, bar, at in queries:
        equal = [(sum(x == y for x, y in zip(s, t)), p) for p, t in rows]
        top = min((-e, p) for e, p in equal)
        want[q] = (sum(e > bar or (e == bar and p < at) for e, p in equal), -top[0], top[1])
    assert {r.q: (r.ahead, r.top_equal, r.top_place) for r in got.collect()} == want


def test_shared_tables(spark):
    from traceloom.operators.shared import materialize, release, shared_dir

    kept = materialize(spark.range(5).withColumn("x", F.lit("a")), "t")
    assert kept.count() == 5 and shared_dir(spark).removeprefix("file://") in kept.inputFiles()[0]
    release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()
