import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import near_duplicates as N
from traceloom.llm import neighbours as V
from traceloom.llm import subsequences as Q

DATA = "/root/testdata/sf0.01"
FUNCS = "id bigint, binary string, complexity bigint, shingles bigint, sig array<bigint>, h1 string, rep int"


def families(rng, groups, size, edits):
    """Signatures in families: copies of a base with some slots changed."""
    out = []
    for _ in range(groups):
        base = rng.integers(-(1 << 62), 1 << 62, 128)
        for _ in range(size):
            s = base.copy()
            at = rng.choice(128, rng.integers(0, edits + 1), replace=False)
            s[at] = rng.integers(-(1 << 62), 1 << 62, len(at))
            out.append(s.tolist())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], FUNCS)


def brute_pairs(rows, least):
    ok = [r for r in rows if r[0] is not None and r[4] is not None and len(r[4]) == 128 and None not in r[4] and (r[2] or 0) >= 4 and (r[3] or 0) > 0]
    sigs = np.array([r[4] for r in ok])
    out = {}
    for i in range(len(ok)):
        agree = (sigs[i] == sigs[i + 1 :]).sum(1)
        for j in np.flatnonzero(agree >= least):
            out[ok[i][0], ok[i + 1 + j][0]] = (int(agree[j]), ok[i][1], ok[i + 1 + j][1])
    return out


def sample_rows(seed=0, groups=25, size=8, edits=20):
    rng = np.random.default_rng(seed)
    sigs = families(rng, groups, size, edits)
    sigs += [sigs[0]] * 6 + [sigs[8]] * 2
    rows = [(i, f"b{i % 4}", 5, 3, s) for i, s in enumerate(sigs)]
    k = len(rows)
    rows += [(k, None, 5, 3, sigs[0]), (k + 1, "b9", None, 3, sigs[0]), (k + 2, "b9", 5, 0, sigs[0]), (k + 3, "b9", 5, 3, None), (k + 4, "b9", 5, 3, sigs[0][:50]), (k + 5, "b9", 3, 3, sigs[0]), (None, "b9", 5, 3, sigs[0]), (k + 6, "b9", 5, 3, sigs[0][:127] + [None])]
    return rows


@pytest.mark.parametrize("shared", [0, 1, 2, 4])
def test_near_duplicate_pairs(spark, monkeypatch, shared):
    rows = sample_rows()
    monkeypatch.setattr(N, "CHUNK", 2)
    if shared:
        # every signature shares segments, so their keys are hot: at first, after two links, and even after the last one
        rows = [(*r[:4], r[4] if r[4] is None or len(r[4]) < 128 else list(range(8 * shared)) + r[4][8 * shared :]) for r in rows]
        monkeypatch.setattr(N, "HOT_KEY", 32)
        monkeypatch.setattr(N, "HOT_SAMPLE", 1)
        levels = N._hot_keys(N.with_digest(N.eligible(table(spark, rows))), 16, N.CHAIN)
        assert len(levels) == {1: 1, 2: 3, 4: 4}[shared]
    want = {p for p, (_, a, b) in brute_pairs(rows, 113).items() if a is not None and b is not None and a != b}
    got = [(r.id_a, r.id_b) for r in N.near_duplicate_pairs(table(spark, rows)).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)


def test_only_hot_keys_of_a_bounded_number_reach_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, "b", 5, 3, [i % 10] * 8 + rng.integers(0, 1 << 60, 120).tolist()) for i in range(400)]
    monkeypatch.setattr(N, "HOT_KEY", 16)
    monkeypatch.setattr(N, "HOT_SAMPLE", 1)
    monkeypatch.setattr(N, "HOT_SHARE", 8)  # no key holds an eighth of the sample
    assert N._hot_keys(N.with_digest(table(spark, rows)), 16, N.CHAIN) == []


def test_copies_in_one_binary_make_no_rows(spark):
    base = list(range(128))
    rows = [(i, "one", 5, 3, base) for i in range(3000)] + [(5000, "two", 5, 3, base), (5001, "two", 5, 3, base[:127] + [-1])]
    got = N.near_duplicate_pairs(table(spark, rows))
    assert got.count() == 6000 and got.where("id_b < 5000").count() == 0


def test_links_and_class_pairs(spark):
    rows = sample_rows(3)
    pairs = brute_pairs(rows, 113)
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    ok = {r[0]: tuple(r[4]) for r in rows if r[0] is not None and r[4] is not None and len(r[4]) == 128 and None not in r[4] and (r[2] or 0) >= 4 and r[3] > 0}
    first = {}
    for i in sorted(ok):
        first.setdefault(ok[i], i)
    got = {r.id: (r.class_id, r.links) for r in N.near_duplicate_links(table(spark, rows)).collect()}
    assert got == {i: (first[s], links[i]) for i, s in ok.items()}
    reps = {(a, b): n for (a, b), (n, _, _) in pairs.items() if n < 128 and first[ok[a]] == a and first[ok[b]] == b}
    assert {(r.rep_a, r.rep_b): r.agree for r in N.near_duplicate_class_pairs(table(spark, rows)).collect()} == reps


def test_connected_groups(spark):
    rows = sample_rows(4, edits=12)
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(rows, 113):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.group_id for r in N.near_duplicate_groups(table(spark, rows)).collect()}
    assert got == {i: root(i) for i in got} and len(got) > 200


@pytest.mark.parametrize("least", [97, 128])
def test_other_budgets(spark, least):
    rows = sample_rows(5, groups=10, edits=33)
    want = {p for p, (_, a, b) in brute_pairs(rows, least).items() if a is not None and b is not None and a != b}
    assert {(r.id_a, r.id_b) for r in N.near_duplicate_pairs(table(spark, rows), least).collect()} == want


def test_budget_bounds_and_empty(spark):
    for bad in (64, 129):
        with pytest.raises(ValueError):
            N.segments_for(bad)
    empty = table(spark, [])
    assert N.near_duplicate_pairs(empty).count() == 0 and N.near_duplicate_links(empty).count() == 0
    assert N.near_duplicate_groups(empty).count() == 0 and V.nearest_rows(empty).count() == 0


def brute_nearest(rows, k, least):
    best = defaultdict(list)
    for (a, b), (n, _, _) in brute_pairs(rows, least).items():
        best[a].append((-n, b))
        best[b].append((-n, a))
    return {(i, j) for i, found in best.items() for _, j in sorted(found)[:k]}


def test_nearest_rows_with_copies_and_ties(spark):
    rows = sample_rows(6, groups=20, edits=30)
    got = {(r.id, r.neighbour_id) for r in V.nearest_rows(table(spark, rows + rows[:3])).collect()}
    assert got == brute_nearest(rows, 5, 90)  # few rows: every list is searched; a row delivered twice is one neighbour


def test_recall_on_the_table(spark):
    funcs = spark.read.parquet(f"{DATA}/funcs.parquet")
    rows = [(r.id, r.binary, r.complexity, r.shingles, r.sig) for r in funcs.select("id", "binary", "complexity", "shingles", "sig").collect()]
    want, got = brute_nearest(rows, 5, 90), {(r.id, r.neighbour_id) for r in V.nearest_rows(funcs).collect()}
    assert len(want & got) >= 0.97 * len(want)


def exact_partners(codes, ids, least, k, allowed=lambda i, j: True):
    out = set()
    for i in range(len(ids)):
        agree = (codes[i].reshape(3, 128) == codes.reshape(-1, 3, 128)).all(axis=1).sum(axis=1)
        best = sorted((-int(agree[j]), int(ids[j])) for j in range(len(ids)) if j != i and agree[j] >= least and allowed(i, j))
        out |= {(int(ids[i]), j, -s) for s, j in best[:k]}
    return out


@pytest.mark.parametrize("split", [None, 150])
def test_best_partners(split):
    rng = np.random.default_rng(7)
    codes = V.code_slots(np.array(families(rng, 8, 50, 30)))
    codes = codes[rng.permutation(len(codes))]
    ids = rng.permutation(1000)[: len(codes)].astype(np.int64)
    got = V.best_partners(codes, ids, 90, 3, split, rows=32, cols=64)
    side = lambda i: i < (split or 0)
    want = exact_partners(codes, ids, 90, 3, lambda i, j: split is None or side(i) != side(j))
    assert len(want) > 300 and set(map(tuple, got.T.tolist())) == want and got.shape[1] == len(want)


def test_graph_recall():
    rng = np.random.default_rng(7)
    codes = V.code_slots(np.array(families(rng, 400, 8, 24)))
    graph = V.Graph(codes[rng.permutation(len(codes))[:1500]], pivots=100)
    number, score = graph.nearest(codes, 5)
    exact = np.sort(V.agreement(codes[:, None, :128], graph.c[None]), axis=1)[:, ::-1]
    assert (score[:, 0] == exact[:, 0]).mean() > 0.9
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in number)


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 60)
    monkeypatch.setattr(V, "LENGTH_SAMPLE", 1)
    sizes = []
    monkeypatch.setattr(V, "CENTROIDS", 4)
    rows = sample_rows(6, groups=20, edits=30)
    asked = V._blocks

    def blocks(*args):
        sizes.append(asked(*args))
        return sizes[-1]

    monkeypatch.setattr(V, "_blocks", blocks)
    got = {(r.id, r.neighbour_id) for r in V.nearest_rows(table(spark, rows), most=4).collect()}
    assert sizes[0].max() >= 3  # few centroids, so lists of more than two blocks
    want = brute_nearest(rows, 5, 90)
    assert got == {p for p in got if p in want} and len(got) >= 0.9 * len(want)


def test_work_on_a_dense_family_is_bounded():
    # every row agrees with every other: far more pairs than rows, of which k per row are held
    import tracemalloc

    rng = np.random.default_rng(9)
    codes = V.code_slots(np.array(families(rng, 1, 3000, 16)))
    tracemalloc.start()
    found = V.best_partners(codes, np.arange(3000), 90, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.shape == (3, 15_000) and peak < 120e6


def test_exact_neighbours_and_recall(spark):
    rows = sample_rows(6, groups=20, edits=30)
    want = {(i, j) for i, j in brute_nearest(rows, 5, 90) if i % 10 == 0}
    got = [(r.id, r.neighbour_id) for r in V.exact_neighbours(table(spark, rows + rows[:3]), F.col("place") % 10 == 0).collect()]
    assert sorted(got) == sorted(want)
    r = V.recall(table(spark, rows), every=10).first()
    assert (r.queries, r.wanted, r.enough) == (len({i for i, _ in want}), len(want), True)
    assert V.recall(table(spark, [])).first().enough


STRUCT = "array<struct<seq int, kind string, sym string, nr bigint>>"
ROWS = f"trace_id bigint, func_id bigint, effects {STRUCT}, steps string, codes int"


def step_rows(rng, funcs, traces, length, steps):
    rows = []
    for t in range(traces):
        f = int(rng.integers(funcs)) if rng.random() > 0.3 else 0  # a hot entity
        effects = []
        for s in range(int(rng.integers(0, length))):
            k = int(rng.integers(steps * 2))
            kind = ("call", f"s{k}", None) if k < steps - 2 else ("syscall", None, k) if k < steps else ("call", None, None) if k % 2 else ("write", "s0", 5)
            effects.append((s, *kind))
        effects += effects[:2]
        rng.shuffle(effects)
        rows.append((t, f, [(int(a), b, c, None if d is None else int(d)) for a, b, c, d in effects], "clash", 1))
    return rows + [(traces, funcs, None, "", 0), (traces + 1, funcs + 1, [], "", 0), (traces + 2, None, [(0, "call", "s0", None)] * 3, "", 0)]


def brute_patterns(rows, share, at_least, lengths=(3, 4)):
    seqs, everyone = defaultdict(set), set()
    for _, f, effects, *_ in rows:
        if f is None:
            continue
        everyone.add(f)
        one = dict(sorted((e[0], e) for e in effects or []))
        steps = tuple(e[2] if e[1] == "call" else f"sys:{e[3]}" for e in one.values() if (e[1] == "call" and e[2] is not None) or (e[1] == "syscall" and e[3] is not None))
        seqs[f].add(steps)
    least = max(at_least, math.ceil(share * len(everyone) - 1e-9))
    found = defaultdict(set)
    for f, many in seqs.items():
        for s in many:
            for n in lengths:
                for p in set(itertools.combinations(s, n)):
                    found[" > ".join(p)].add(f)
    return {p: len(w) for p, w in found.items() if len(w) >= least}


@pytest.mark.parametrize(("part", "chunk", "short"), [(10_000, 10_000, 1 << 16), (7, 10_000, 1), (7, 5, 1 << 16)])
def test_frequent_subsequences(spark, monkeypatch, part, chunk, short):
    monkeypatch.setattr(Q, "CHUNK", chunk)
    monkeypatch.setattr(Q, "SHORT_CODES", short)
    rows = step_rows(np.random.default_rng(1), 40, 160, 12, 6)
    want = brute_patterns(rows, 0.1, 3)
    got = {r.pattern: r.support for r in Q.frequent_subsequences(spark.createDataFrame(rows, ROWS), 0.1, 3, part_entities=part).collect()}
    assert len(want) > 20 and got == want


def test_long_sequences_and_none(spark):
    long = [(i, "call", f"s{i % 3}" if i in (0, 70, 150, 299) else "x", None) for i in range(300)]
    rows = [(k, k, long if k % 2 else long[:100], "", 0) for k in range(12)]
    got = {r.pattern: r.support for r in Q.frequent_subsequences(spark.createDataFrame(rows, ROWS), 0.025, 5).collect()}
    assert got["s0 > s1 > s0"] == 6 and got["s0 > s1 > s0 > s2"] == 6 and got["s0 > s1 > x"] == 12 and "s1 > s0 > s1" not in got
    df = spark.createDataFrame(rows[:0], ROWS)
    assert Q.frequent_subsequences(df).count() == 0
    assert Q.frequent_subsequences(spark.createDataFrame(rows[:3], ROWS)).count() == 0
    assert Q.frequent_subsequences(spark.createDataFrame([(1, 1, None, "", 0)], ROWS), at_least=1).count() == 0


def test_shift_marks_what_follows_the_first_bit():
    w = np.array([[0, 8, 0], [1, 0, 0], [1 << 63, 1, 0], [6, 2, 2]], np.uint64)
    got = Q.Bitmaps.after_first(w)
    full = (1 << 64) - 1
    assert got.tolist() == [[0, full & ~15, full], [full & ~1, full, full], [0, full, full], [full & ~3, full, full]]


def test_eligible_needs_all_fields(spark):
    assert N.eligible(table(spark, sample_rows())).where(F.col("complexity").isNull()).count() == 0
