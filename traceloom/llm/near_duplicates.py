"""Near-duplicate records with small edits (problem 1): pigeonring filtering before the full Hamming check.

A signature of 128 slots is cut into a ring of segments. With a budget of t differing slots over m segments there is a
segment from which on every chain of l consecutive segments holds at most floor(l * t / m) differences. Since t < m the
first segment of that chain agrees exactly, so an equi-join on (segment, hash of its slots) finds every pair; the next
segments, carried as one-byte sketches of their slots, must keep their share of the budget before a pair is a candidate.
A sketch can hide a difference but never invent one, so no pair is lost. The full check compares all slots.

Keys that very many distinct signatures share are refined along the chain, link by link. Over the first L links after the
first segment at most L slots differ, so at least L of their 2 L halves agree: with L - 1 agreeing halves in the key already,
one more of the others can be added, and the pair meets under that key. A key that is hot even after the last link is
dealt to pairs of tiles, so that its comparisons spread over tasks. All of this changes the plan, never the pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.binding import let
from traceloom.operators.shared import discard, materialize, store

SLOTS = 128
MIN_AGREE = 113
CHAIN = 4
#: Keys that more distinct signatures share than this, and than one in HOT_SHARE of all, are refined.
HOT_KEY = 4096
HOT_SAMPLE = 16
HOT_SHARE = 1000
#: Tiles of a key that is hot after its last refinement.
TILES = 8
#: Rows of one signature and one binary that are expanded together.
CHUNK = 1024


def eligible(funcs: DataFrame) -> DataFrame:
    """Rows with an id, a signature of 128 slots, none of them null, and enough signal. Null fields make a row ineligible."""
    signal = (F.col("complexity") >= 4) & (F.col("shingles") > 0) & F.col("id").isNotNull()
    return funcs.where(signal & (F.size("sig") == SLOTS) & ~F.exists("sig", lambda x: x.isNull()))


def with_digest(rows: DataFrame) -> DataFrame:
    """Adds ``h1``, ``h2``: 128 bits that stand for the signature when equal ones are brought together."""
    return rows.withColumns({"h1": F.xxhash64("sig"), "h2": F.xxhash64(F.lit(1), F.col("sig"))})


def segments_for(min_agree: int) -> int:
    """The smallest number of segments that is more than the budget of differences."""
    budget = SLOTS - min_agree
    for m in (16, 32, 64):
        if 0 <= budget < m:
            return m
    raise ValueError("min_agree must lie between 65 and 128")


def _byte(x: Column) -> Column:
    folded = x.bitwiseXOR(F.shiftrightunsigned(x, 23)).bitwiseXOR(F.shiftrightunsigned(x, 41))
    return folded.bitwiseAND(F.lit(255))


def _sketches(sig: Column, m: int) -> Column:
    """One long per segment: a byte of every slot."""
    width = SLOTS // m

    def pack(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 8).bitwiseOR(_byte(x)))

    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: pack(F.slice(sig, i * width + 1, width)))


def _keys(sig: Column, m: int) -> Column:
    width = SLOTS // m
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.xxhash64(F.slice(sig, i * width + 1, width)))


def _halves(sig: Column, m: int) -> Column:
    """Hashes of both halves of every segment."""
    half = SLOTS // m // 2
    return F.transform(F.sequence(F.lit(0), F.lit(2 * m - 1)), lambda i: F.xxhash64(F.slice(sig, i * half + 1, half)))


def _differences(a: Column, b: Column) -> Column:
    """How many of the eight bytes differ."""
    x = a.bitwiseXOR(b)
    for s in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, s))
    return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def _hot_keys(rows: DataFrame, m: int, chain: int) -> list[DataFrame]:
    """Hot keys of each level of refinement, from a sample of the distinct signatures by digest; ends where none is hot.

    Counting and filtering are distributed. A hot key holds at least one in HOT_SHARE of the sample, and a signature has m
    keys, 2 m after the first link, 6 m after the second and 24 m after the third, so at most 1000 times these numbers
    exist, whatever the corpus; usually there are none.
    """
    sample = rows.where(F.pmod("h1", F.lit(HOT_SAMPLE)) == 0).dropDuplicates(["h1", "h2"])
    levels: list[DataFrame] = []
    total = None
    while len(levels) < chain:
        keys = postings(sample, m, chain, levels, may_refine=True).groupBy("seg", "key").count().where(F.col("count") >= HOT_KEY // HOT_SAMPLE)
        if total is None:
            if keys.isEmpty():
                break
            total = sample.count()
        # keys of earlier levels that are left aren't hot, so these are of the newest level
        hot = keys.where(F.col("count") * HOT_SHARE >= total).select("seg", "key").toArrow().combine_chunks()
        if not hot.num_rows:
            break
        levels.append(rows.sparkSession.createDataFrame(hot).withColumn("hot", F.lit(True)))
    return levels


def postings(classes: DataFrame, m: int, chain: int, hot: list[DataFrame], may_refine: bool = False) -> DataFrame:
    """One row per class and segment: ``seg``, ``key`` and the sketches ``c1`` .. of the segments that follow on the ring; where
    a key is hot, one row for each way to refine it. With tiles also ``tile`` and ``within``."""
    refined = bool(hot) or may_refine
    links = range(1, chain)

    def rows(b: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(m - 1)),
            lambda i: F.struct(
                i.alias("seg"),
                F.get(b["k"], i).alias("key"),
                *(F.get(b["s"], (i + j) % m).alias(f"c{j}") for j in links),
                *([F.array(*(F.get(b["h"], ((i + j) % m) * 2 + x) for j in links for x in (0, 1))).alias("h")] if refined else []),
            ),
        )

    sig = F.col("sig")
    parts = [_keys(sig, m).alias("k"), _sketches(sig, m).alias("s"), *([_halves(sig, m).alias("h")] if refined else [])]
    out = classes.select("h1", "h2", F.inline(let(F.struct(*parts), rows)))
    if not refined:
        return out
    out = out.withColumn("used", F.lit(0))
    for level, table in enumerate(hot[: chain - 1], 1):
        # the halves of the first ``level`` links that the key doesn't hold yet
        ways = [
            F.when(F.col("used").bitwiseAND(F.lit(1 << j)) == 0, F.struct(F.xxhash64("key", F.lit(j), F.get("h", F.lit(j))).alias("key"), F.col("used").bitwiseOR(F.lit(1 << j)).alias("used")))
            for j in range(2 * level)
        ]
        as_is = F.array(F.struct(F.col("key"), F.col("used")))
        out = out.join(F.broadcast(table), ["seg", "key"], "left").withColumn("_k", F.explode(F.when(F.col("hot"), F.array_compact(F.array(*ways))).otherwise(as_is)))
        out = out.withColumns({"key": F.col("_k.key"), "used": F.col("_k.used")}).drop("_k", "hot")
    if len(hot) == chain:
        out = out.join(F.broadcast(hot[-1]), ["seg", "key"], "left")
        tile = F.when(F.col("hot"), F.pmod("h1", F.lit(TILES)).cast("int")).otherwise(-1)
        out = out.withColumn("tile", tile)
        pairs = F.transform(
            F.sequence(F.lit(0), F.lit(TILES - 1)),
            lambda x: F.struct(F.xxhash64("key", F.least("tile", x), F.greatest("tile", x)).alias("key"), (F.col("tile") == x).alias("within")),
        )
        alone = F.array(F.struct(F.col("key"), F.lit(True).alias("within")))
        out = out.withColumn("_k", F.explode(F.when(F.col("hot"), pairs).otherwise(alone))).withColumns({"key": F.col("_k.key"), "within": F.col("_k.within")}).drop("_k", "hot")
    return out.drop("h", "used")


def class_pairs(funcs: DataFrame, min_agree: int = MIN_AGREE, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Classes of equal signatures and the pairs of classes that agree in at least ``min_agree`` slots.

    Returns (classes: ``h1, h2, rep, members, sig``; pairs: ``a1, a2, b1, b2, agree``). ``rep`` is the smallest id.
    """
    m = segments_for(min_agree)
    budget = SLOTS - min_agree
    rows = with_digest(eligible(funcs).select("id", "sig"))
    classes = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("members"), F.any_value("sig").alias("sig"))
    hot = _hot_keys(rows, m, chain)
    posted = postings(classes, m, chain, hot)
    a, b = posted.alias("a"), posted.alias("b")
    test = (F.col("a.seg") == F.col("b.seg")) & (F.col("a.key") == F.col("b.key"))
    test &= F.struct("a.h1", "a.h2") < F.struct("b.h1", "b.h2")
    if len(hot) == chain:
        test &= F.col("a.within") | (F.col("a.tile") != F.col("b.tile"))
    spent: Column | None = None
    for j in range(1, chain):
        d = _differences(F.col(f"a.c{j}"), F.col(f"b.c{j}"))
        spent = d if spent is None else spent + d
        test &= spent <= F.lit((j + 1) * budget // m)
    candidates = a.join(b, test).select(
        F.col("a.h1").alias("a1"), F.col("a.h2").alias("a2"), F.col("b.h1").alias("b1"), F.col("b.h2").alias("b2")
    ).distinct()
    left = classes.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("sig").alias("sig_a"))
    right = classes.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("sig").alias("sig_b"))
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    checked = candidates.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).withColumn("agree", agree)
    return classes, checked.where(F.col("agree") >= min_agree).select("a1", "a2", "b1", "b2", "agree")


def near_duplicate_pairs(funcs: DataFrame, min_agree: int = MIN_AGREE) -> DataFrame:
    """All pairs ``id_a < id_b`` of eligible rows with different ``binary`` text that agree in at least ``min_agree`` slots.

    Rows of one signature are one class during the search. Pairs of classes become pairs of (class, binary) with different
    binaries, and only those are expanded to ids, at most ``CHUNK`` rows of a class and binary at a time: copies inside one
    binary, however many, make no row. Null or short signatures, null complexity or shingles make a row ineligible; a
    null ``binary`` differs from nothing, so such rows are in no pair. A row delivered twice under one id pairs twice.
    Empty tables give no rows; further columns are left out.
    """
    classes, pairs = class_pairs(funcs, min_agree)
    whole = with_digest(eligible(funcs).select("id", "binary", "sig")).where(F.col("binary").isNotNull()).select("h1", "h2", "id", "binary")
    groups = whole.groupBy("h1", "h2", "binary").agg(F.floor((F.count("*") - 1) / CHUNK).cast("int").alias("last"))
    # classes whose rows all lie in one binary have no pair of their own
    mixed = groups.groupBy("h1", "h2").agg(F.min("binary").alias("lo"), F.max("binary").alias("hi")).where("lo <> hi")
    alone = mixed.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))

    def side(df: DataFrame, c: str, tag: str) -> DataFrame:
        return df.select(F.col("h1").alias(f"{c}1"), F.col("h2").alias(f"{c}2"), *(F.col(x).alias(f"{tag}_{x}") for x in df.columns if x not in ("h1", "h2")))

    both = pairs.drop("agree").unionByName(alone).join(side(groups, "a", "x"), ["a1", "a2"]).join(side(groups, "b", "y"), ["b1", "b2"])
    same = (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))
    both = both.where((F.col("x_binary") != F.col("y_binary")) & (~same | (F.col("x_binary") < F.col("y_binary"))))
    for tag in ("x", "y"):
        both = both.withColumn(f"{tag}_part", F.explode(F.sequence(F.lit(0), F.col(f"{tag}_last")))).drop(f"{tag}_last")
    parts = F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int").alias("part")
    members = whole.join(groups.where("last > 0"), ["h1", "h2", "binary"], "left").select("h1", "h2", "id", "binary", F.coalesce(parts, F.lit(0)).alias("part"))
    found = both.join(side(members, "a", "x"), ["a1", "a2", "x_binary", "x_part"]).join(side(members, "b", "y"), ["b1", "b2", "y_binary", "y_part"])
    return found.where("x_id <> y_id").select(F.least("x_id", "y_id").alias("id_a"), F.greatest("x_id", "y_id").alias("id_b"))


def near_duplicate_links(funcs: DataFrame, min_agree: int = MIN_AGREE) -> DataFrame:
    """One row per eligible row: ``id``, ``class_id`` (smallest id with the same signature) and ``links``.

    ``links`` counts the other eligible rows that agree in at least ``min_agree`` slots, equal ones included and in
    whatever binary; it is computed from class sizes, without making the pairs of rows.
    """
    classes, pairs = class_pairs(funcs, min_agree)
    sizes = classes.select("h1", "h2", "rep", "members")
    ends = [("a1", "a2", "b1", "b2"), ("b1", "b2", "a1", "a2")]
    ways = [pairs.select(*(F.col(c).alias(n) for c, n in zip(e, ("h1", "h2", "o1", "o2")))) for e in ends]
    other = sizes.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("members").alias("n"))
    counts = reduce(DataFrame.unionByName, ways).join(other, ["o1", "o2"]).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    links = sizes.join(counts, ["h1", "h2"], "left").select(
        "h1", "h2", F.col("rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("links")
    )
    rows = with_digest(eligible(funcs).select("id", "sig")).select("h1", "h2", "id")
    return rows.join(links, ["h1", "h2"]).select("id", "class_id", "links")


def near_duplicate_class_pairs(funcs: DataFrame, min_agree: int = MIN_AGREE) -> DataFrame:
    """Pairs of class representatives that agree in at least ``min_agree`` slots: ``rep_a < rep_b`` and ``agree``."""
    classes, pairs = class_pairs(funcs, min_agree)
    reps = classes.select("h1", "h2", "rep")
    one = reps.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("rep").alias("x"))
    two = reps.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("rep").alias("y"))
    both = pairs.join(one, ["a1", "a2"]).join(two, ["b1", "b2"])
    return both.select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "agree")


def near_duplicate_groups(funcs: DataFrame, min_agree: int = MIN_AGREE) -> DataFrame:
    """One row per eligible row: ``id``, ``class_id`` and ``group_id``, the smallest id that a chain of links leads to.

    Components of the graph of classes by large-star and small-star steps: every round links each node's larger, then
    all of its neighbours to the smallest one known, which halves the height of every tree. Rounds are written to the
    shared folder and end when the edges no longer change; nothing but their number and a checksum reaches the driver.
    """
    classes, pairs = class_pairs(funcs, min_agree)
    reps = materialize(classes.select("h1", "h2", "rep"), "reps")
    one = reps.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("rep").alias("x"))
    two = reps.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("rep").alias("y"))
    links = pairs.join(one, ["a1", "a2"]).join(two, ["b1", "b2"]).select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Neighbours of each node move to the smallest of its neighbourhood: larger ones, or itself and smaller ones."""
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(least, "u")
        if large:
            out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u > v").distinct()

    sum_of = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))
    (edges, path), last = store(links.distinct(), "links"), None
    while True:
        mark = edges.agg(F.count("*"), sum_of).first()
        if mark == last:
            break
        (edges, fresh), last = store(star(star(edges, True), False), "links"), mark
        discard(funcs.sparkSession, path)  # the new round is stored, nothing reads the old one
        path = fresh
    roots = reps.join(edges.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left")
    roots = roots.select("h1", "h2", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"))
    rows = with_digest(eligible(funcs).select("id", "sig")).select("h1", "h2", "id")
    return rows.join(roots, ["h1", "h2"]).select("id", "class_id", "group_id")
