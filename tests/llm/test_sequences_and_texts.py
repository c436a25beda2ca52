import json
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traceloom.functions.effects import TRACES
from traceloom.llm import packing as K
from traceloom.llm import repetition as R
from traceloom.llm import runs as U
from traceloom.llm import tokenize as T
from traceloom.llm import top_n as N

DATA = "/root/testdata/sf0.01"
NAMED = "named_id bigint, target string, entry bigint, guess string, from_binary string, similarity double, rank int, _salt string"


# ---- top n -----------------------------------------------------------------------------------------------------------


def brute_top(rows, n):
    key = lambda r: (-r[5], r[3] is None, r[3] or "", r[4] is None, r[4] or "", r[0])
    groups = {}
    for r in sorted((r for r in rows if r[2] is not None and r[5] is not None and not math.isnan(r[5]) and 0 <= r[5] <= 1), key=key):
        found = groups.setdefault((r[1], r[2]), {})
        found.setdefault((r[3], r[4], r[5] + 0.0), r[0])
    return {i for found in groups.values() for i in list(found.values())[:n]}


@pytest.mark.parametrize("n", [1, 3])
def test_top_n(spark, n):
    rng = random.Random(n)
    score = lambda: rng.choice([0.0, -0.0, 0.5, 0.5, 1.0, 1.1, -0.1, math.nan, None])
    rows = [
        (i, rng.choice(["hot", "hot", "hot", f"t{i % 9}"]), rng.choice([1, 1, 2, None]), rng.choice(["a", "b", None, ""]), rng.choice(["x", "y", None]), score(), 9, "s")
        for i in range(900)
    ]
    rows += [(1000 + r[0], *r[1:]) for r in rows[:300]]
    out = N.top_guesses(spark.createDataFrame(rows, NAMED), n).collect()
    assert {r.named_id for r in out} == brute_top(rows, n) and len(out) == len({r.named_id for r in out})
    assert max(r["rank"] for r in out) == n


def test_top_n_empty(spark):
    assert N.top_guesses(spark.createDataFrame([], NAMED)).count() == 0


def test_survivors_are_bounded(spark):
    # a group of copies of its best item, and one of very many items
    rows = spark.range(60_000).selectExpr("id AS named_id", "'t' AS target", "1L AS entry", "'best' AS guess", "'b' AS from_binary", "1.0D AS similarity")
    many = spark.range(60_000).selectExpr("id + 60000 AS named_id", "'u' AS target", "1L AS entry", "concat('g', id) AS guess", "'b' AS from_binary", "(id % 128) / 128 AS similarity")
    left = N._survivors(rows.unionByName(many), ["target", "entry"], "similarity", ["guess", "from_binary"], "named_id", 3, None, 16).groupBy("target").count()
    assert {r.target: r["count"] for r in left.collect()} == {"t": 1, "u": 3 * 16}
    assert [r.named_id for r in N.top_guesses(rows).collect()] == [0]


def test_limit_is_applied_before_the_shuffle(spark):
    plan = N.top_guesses(spark.read.parquet(f"{DATA}/named.parquet"))._jdf.queryExecution().executedPlan().toString()
    # copies are dropped in the map tasks, and no more than n items a subgroup leave a task
    assert "partial_min" in plan[plan.rindex("Exchange hashpartitioning") :]
    assert all("WindowGroupLimit" in part for part in plan.split("Exchange hashpartitioning")[1:3])


# ---- runs ------------------------------------------------------------------------------------------------------------

KEYS = ("seq", "ic", "kind", "region", "region_k", "off", "val", "val_k", "sym", "nr")


def brute_runs(rows, least):
    out = set()
    for r in rows:
        one = {}
        for e in r[4] or []:
            if e[0] is not None:
                one.setdefault(e[0], e)
        run = []
        for e in [one[s] for s in sorted(one)] + [None]:
            if run and (e is None or [e[k] for k in (2, 3, 4, 6, 8, 9)] != [run[-1][k] for k in (2, 3, 4, 6, 8, 9)]):
                if len(run) >= least:
                    out.add((r[0], run[0][0], run[-1][0], len(run), None if run[0][1] is None or run[-1][1] is None else run[-1][1] - run[0][1]))
                run = []
            if e is not None:
                run.append(e)
    return out


@pytest.mark.parametrize("least", [1, 3])
def test_runs(spark, least):
    rng, rows = random.Random(least), []
    for t in range(150):
        effects, ic = [], 0
        for s in range(rng.randrange(40)):
            ic += rng.randrange(5)
            kind = rng.choice(["write", "write", "branch", "call"])
            effects.append((s * 2, None if rng.random() < 0.03 else ic, kind, rng.choice(["arg", None]), rng.choice([None, 0]) if rng.random() < 0.2 else 1, rng.randrange(9), None, rng.randrange(9), rng.choice(["f", None]) if kind == "call" else None, None))
        effects += effects[:3]
        if t % 3 == 0:
            rng.shuffle(effects)
        effects.append((None, 1, "ret", None, None, None, None, None, None, None))
        rows.append((t, t, "b", 0, effects, 5, False, None, None))
    rows += [(200, 1, "b", 0, None, 5, False, None, None), (201, 1, "b", 0, [], 5, False, None, None), (201, 1, "b", 0, rows[0][4], 5, False, None, None)]
    out = U.collapse_runs(spark.createDataFrame(rows, TRACES), least).collect()
    assert {(r.trace_id, r.first_seq, r.last_seq, r.n_effects, r.duration) for r in out} == brute_runs(rows, least)
    assert U.collapse_runs(spark.createDataFrame([], TRACES), least).count() == 0


EVENTS = "trace_id bigint, seq int, ic bigint, kind string, region string, region_k int, val string, sym string, nr bigint, first_seq string, _id string"


@pytest.mark.parametrize(("least", "chunks"), [(1, 1), (1, 7), (3, 40), (2, None)])
def test_event_rows(spark, monkeypatch, least, chunks):
    rng, rows = random.Random(least), []
    for t in [*range(30), None]:
        ic = 0
        for s in range(900 if t == 3 else rng.randrange(25)):  # a hot entity that spans many chunks, with runs as long as chunks
            ic += rng.randrange(5)
            kind = "write" if t == 3 and 200 < s < 700 else rng.choice(["write", "write", "call"])
            rows.append((t, s * 2, None if rng.random() < 0.05 else ic, kind, None, 1, None, None, None, "clash", "c"))
    rows += rows[:40] + [(1, None, 1, "write", None, 1, None, None, None, "", "")]
    rng.shuffle(rows)
    lists = {}
    for r in rows:
        lists.setdefault(r[0], []).append((r[1], r[2], r[3], r[4], r[5], None, r[6], None, r[7], r[8]))
    want = brute_runs([(t, 0, "", 0, sorted(e, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0))) for t, e in lists.items()], least)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        out = U.collapse_event_rows(spark.createDataFrame(rows, EVENTS), least, chunks=chunks).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(want) and {(r.trace_id, r.first_seq, r.last_seq, r.n_effects, r.duration) for r in out} == want
    assert U.collapse_event_rows(spark.createDataFrame([], EVENTS), least).count() == 0


# ---- tokenizer -------------------------------------------------------------------------------------------------------

DOCS = "doc_id bigint, text string, ids string, _id int"


NAMES = ("byte_bpe_50k", "word_bpe_49k")  # all public tokenizers whose file the library reads


def text_of(name="byte_bpe_50k"):
    return Path(T.tokenizer_path(name)).read_text(encoding="utf-8")


def library(texts, name="byte_bpe_50k"):
    tok = T.load(T.tokenizer_path(name))
    return [list(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


TEXTS = ["", " ", "\n\n a", "a\n b\n\nc  d", "<|endoftext|>", "é\nabc 'S 's", "it's don't'll 12ab  \t\n", "\x1c\x1f a\x0b\x0cb", "日本\nabc\r\nq", "a\n'x' b\ńb\n's", "👩‍👩‍👧\n a b", "x" * 5000, "a b\n" * 3000, "٣4½Ⅷ\nok", "﻿abc\u0085d"]


@pytest.mark.parametrize("name", NAMES)
def test_encoder_equals_the_library(name):
    texts = [*TEXTS, "I'LL", "'Tis O'Neil'S  DON'T", "a" * 300]
    assert [np.frombuffer(b, np.int32).tolist() for b in T.Encoder(text_of(name)).encode(texts)] == library(texts, name)


@pytest.mark.parametrize("name", NAMES)
def test_every_document_equals_the_library(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.ids for r in T.encode_ids(docs, T.tokenizer_path(name)).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == {r.doc_id: ids for r, ids in zip(rows, library([r.text for r in rows], name))}


def test_short_way_only_for_plain_byte_level():
    plain, words = (json.loads(text_of(n)) for n in NAMES)
    assert T.plain_byte_level(plain) and not T.plain_byte_level(words)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": plain["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}},
                   {"model": plain["model"] | {"dropout": 0.1}}, {"model": plain["model"] | {"end_of_word_suffix": "</w>"}}, {"added_tokens": [{"special": False}]}):
        assert not T.plain_byte_level(plain | change)


def test_executors_need_no_file(spark, tmp_path):
    path = tmp_path / "own.json"
    path.write_text(text_of("word_bpe_49k"), encoding="utf-8")
    ids = T.encode_ids(spark.createDataFrame([(1, "Hello  WORLD"), (2, None)], "doc_id bigint, text string"), str(path))
    path.unlink()
    assert {r.doc_id: r.ids for r in ids.collect()} == {1: library(["Hello  WORLD"], "word_bpe_49k")[0], 2: []}
    back = T.decode_ids(ids, T.tokenizer_path("word_bpe_49k")).collect()
    assert {r.doc_id: r.text for r in back} == {1: "hello world ", 2: ""}
    spans = T.encode_offsets(spark.createDataFrame([(1, "Hello  WORLD")], "doc_id bigint, text string"), T.tokenizer_path("word_bpe_49k")).first()
    assert (spans.starts[0], spans.ends[-1]) == (0, 12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("\n\n \t'sabZ09.é")), max_size=60), max_size=5))
def test_encoder_equals_the_library_on_any_text(texts):
    assert [np.frombuffer(b, np.int32).tolist() for b in T.encoder(text_of()).encode(texts)] == library(texts)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "MEMO_ENTRIES", 5)
    monkeypatch.setattr(T, "MEMO_CHARS", 3)
    enc, texts = T.Encoder(text_of()), ["alpha beta", "ab cd ef gh ij kl mn", "alpha"]
    for t in texts * 2:
        assert np.frombuffer(enc.encode([t])[0], np.int32).tolist() == library([t])[0]
        assert len(enc.memo) <= 5 + 7


def test_round_trip_offsets_and_counts(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate([*TEXTS, None])] + [(0, "twice", "c", 1)], DOCS)
    ids = T.encode_ids(docs)
    got = sorted((r.doc_id, r.ids) for r in ids.collect())
    assert got == sorted([*enumerate(library([*TEXTS, None])), (0, library(["twice"])[0])])
    assert sorted((r.doc_id, r.text) for r in T.decode_ids(ids).collect()) == sorted([*enumerate([*TEXTS, ""]), (0, "twice")])
    assert sorted((r.doc_id, r.n_tokens) for r in T.count_tokens(docs).collect()) == sorted((d, len(x)) for d, x in got)
    for r in T.encode_offsets(docs).where("doc_id > 0").collect():
        text = (TEXTS + [""])[r.doc_id] or ""
        assert len(r.starts) == len(r.ends) == len(r.ids) and all(0 <= a <= b <= len(text) for a, b in zip(r.starts, r.ends))
        if text.isascii():
            assert "".join(text[a:b] for a, b in zip(r.starts, r.ends)) == text
        if text:
            assert r.starts[0] == 0 and r.ends[-1] == len(text) and all(b - 1 <= a <= b for a, b in zip(r.starts[1:], r.ends))
    cut = spark.createDataFrame([(1, library(["日"])[0][:1]), (2, [70000, -1]), (3, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in T.decode_ids(cut).collect()} == {1: "�", 2: "��", 3: ""}
    assert T.encode_ids(docs.limit(0)).count() == 0


# ---- containers ------------------------------------------------------------------------------------------------------


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_length_buckets_are_optimal():
    import itertools

    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 4):
        lengths = np.sort(rng.choice(200, 9, replace=False)) + 1
        counts = rng.integers(1, 50, 9)
        bounds = K.length_buckets(lengths, counts, k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(k) for c in itertools.combinations(lengths[:-1].tolist(), n))
        assert len(bounds) <= k and padding(lengths, counts, bounds.tolist()) == best


SIZED = "doc_id bigint, n_tokens bigint, size int, bucket string"


@pytest.mark.parametrize("top_up", [True, False])
def test_pack(spark, monkeypatch, top_up):
    monkeypatch.setattr(K, "PART_ITEMS", 300)
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in np.minimum(9000, rng.lognormal(5, 1.2, 2500)).astype(int)] + [0, 0, 2048, 2049, 4096, 1, 2047] + [700] * 800
    rows = [(i, s, 1, "clash") for i, s in enumerate(sizes)] + [(9999, None, 1, ""), (0, sizes[0], 1, "")]
    out = K.pack(spark.createDataFrame(rows, SIZED), 2048, top_up=top_up, buckets=32).collect()
    load, seen = {}, {}
    for r in out:
        load[r.container] = load.get(r.container, 0) + r.size
        seen.setdefault(r.doc_id, []).append((r.start, r.size))
        assert r.size <= r.bucket or r.size == 0
    assert max(load.values()) <= 2048
    for i, s, *_ in rows[:-1]:
        got = sorted(set(seen[i])) if i == 0 else sorted(seen[i])
        s = s or 0
        assert sum(n for _, n in got) == s and len(got) == max(1, -(-s // 2048))
        assert [a for a, _ in got] == [k * 2048 for k in range(len(got))]
    full = sorted(load)
    assert full == list(range(len(full)))
    if top_up:
        assert sum(load.values()) / (len(load) * 2048) > 0.95


def test_pack_edges(spark):
    empty = spark.createDataFrame([], SIZED)
    assert K.pack(empty, 2048).count() == 0
    zero = K.pack(spark.createDataFrame([(1, 0, 1, ""), (2, None, 1, "")], SIZED), 2048).collect()
    assert [(r.size, r.container) for r in zero] == [(0, 0), (0, 0)]
    big = K.pack(spark.createDataFrame([(1, 100_001, 1, ""), (2, 7, 1, ""), (3, 60_000, 1, ""), (4, 40_000, 1, "")], SIZED), 100_000).collect()
    load = {}
    for r in big:
        load[r.container] = load.get(r.container, 0) + r.size
    assert sum(load.values()) == 200_008 and max(load.values()) <= 100_000
    rules = lambda packed, docs: {r.rule: r.n for r in K.broken_rules(docs, packed, 20).collect()}
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    fine = K.pack(spark.createDataFrame([(1, 45, 1, ""), (2, 20, 1, ""), (3, None, 1, "")], SIZED), 20)
    assert rules(fine, docs) == {"documents": 3, "missing": 0, "cut_small": 0, "torn": 0, "overfull": 0}
    bad = spark.createDataFrame([(1, 0, 0, 5, 0), (1, 1, 6, 5, 0), (2, 0, 0, 20, 0)], "doc_id bigint, piece int, start bigint, size bigint, container bigint")
    assert rules(bad, docs) == {"documents": 3, "missing": 1, "cut_small": 1, "torn": 1, "overfull": 1}
    report = K.fill_report(K.pack(spark.createDataFrame([(1, 10, 1, ""), (2, 10, 1, "")], SIZED), 20), 20).first()
    assert (report.containers, report.items, report.fill) == (1, 2, 1.0)


# ---- repetition ------------------------------------------------------------------------------------------------------


def brute_repetition(text):
    words = [w.translate(str.maketrans(R.UPPER, R.LOWER)) for w in re.split("[ \t\n\r]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len(words), 1 - len(set(windows)) / len(windows) if windows else 0.0


def test_repetition(spark):
    rng = random.Random(5)
    texts = [None, "", "  \n\t ", "a b c d", "a b c d e", "A b C d e " * 30, "É é " * 20, "x y z " * 30, "one two three four five six seven eight nine ten " * 2 + "q"]
    texts += [" ".join(rng.choice("aAbBc") for _ in range(rng.randrange(60))) + rng.choice(["", "\r\n", "\t"]) for _ in range(300)]
    texts += ["word " * 200_000, " ".join(str(i) for i in range(50_000))]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)], "doc_id bigint, text string, broken string, _m string")
    want = {i: brute_repetition(t) for i, t in enumerate(texts)}
    got = {r.doc_id: (r.n_words, r.window_share) for r in R.measure(docs, R.REPEATED).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - s) < 1e-12 for k, (n, s) in want.items())
    assert {r.doc_id for r in R.repeated_documents(docs).collect()} == {k for k, (n, s) in want.items() if n >= 20 and s >= 0.4}
    assert R.repeated_documents(docs.limit(0)).count() == 0


def test_measures(spark):
    text = "Same line.\nSame line.\nOther!\r\n\r\nPara the of.\n\nPara the of.\n\n***"
    chinese = "这是一个很长的句子没有任何空格" * 4
    docs = spark.createDataFrame([(1, text), (2, None), (3, chinese), (4, "カタカナの文と の ひらがな"), (5, "один и два не три " * 3)], "doc_id bigint, text string")
    rules = (*R.QUALITY, R.Threshold("lines", "line_share", high=0.3), R.Threshold("words", "n_words", low=20))
    a, b, c, d, e = R.measure(docs, rules).orderBy("doc_id").collect()
    assert a.line_share == pytest.approx(1 - 4 / 6) and a.stop_words == 1 and a.n_units == a.n_words == 12
    assert a.line_chars == pytest.approx(1 - (10 + 6 + 12 + 3) / (20 + 6 + 24 + 3)) and 0 < a.paragraph_chars < 0.3
    assert a.sentence_chars == pytest.approx(1 - (9 + 5 + 11 + 3) / (18 + 5 + 22 + 3))
    assert a.repeated_share == max(a.line_chars, a.paragraph_chars, a.sentence_chars, a.unit_share)
    assert {"length", "repeated_lines", "repeated_sentences", "lines", "words"} <= set(a.broken)
    assert (b.n_units, b.line_chars, b.symbol_ratio, b.window_share, b.repeated_share) == (0, 0.0, 0.0, 0.0, 0.0)
    # one word by white space, but sixty units whose windows of ten repeat
    assert (c.n_words, c.window_share, c.n_units) == (1, 0.0, 60) and c.unit_share == pytest.approx(1 - 15 / 51) and c.stop_words == 5
    assert c.repeated_share == c.unit_share and "repeated" in c.broken and "stop_words" not in c.broken
    assert d.n_units == 12 and d.stop_words == 5
    assert e.stop_words == 2 and e.unit_share == pytest.approx(1 - 5 / 11)


def test_stop_words_fit_the_corpus(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) >= 200 AND lang IS NOT NULL")
    rows = R.measure(docs).join(docs.select("doc_id", "lang"), "doc_id")
    for r in rows.groupBy("lang").agg(F.avg(F.array_contains("broken", "stop_words").cast("int")).alias("share"), F.count("*").alias("n")).collect():
        assert r.n < 20 or r.share < 0.25, r


def test_measures_need_no_shuffle_by_key_and_no_python(spark):
    plan = R.measure(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Python" not in plan and "Arrow" not in plan
