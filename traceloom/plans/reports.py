"""The engine's reports as DataFrames: match, query, triage, evaluate, dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.functions import render
from traceloom.functions.effects import in_order
from traceloom.functions.hashing import unsigned_order
from traceloom.functions.signature import similarity
from traceloom.operators.blocks import against_all, best_with_tag
from traceloom.operators.corpus import has_signal, is_known, well_formed
from traceloom.operators.matching import best_in_each, best_match
from traceloom.operators.numbering import number_rows


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


# ---- match -----------------------------------------------------------------------------------------------------------


def match_by_name(a: DataFrame, b: DataFrame, order: str = "id") -> DataFrame:
    """``name, status, similarity`` of every name on either side: same, changed, low_signal, only_a or only_b.

    Of several rows with one name on a side the last by ``order`` counts; rows without a name take no part. Below the
    signal gate on either side the status is low_signal and no similarity is given.
    """

    def last(df: DataFrame, tag: str) -> DataFrame:
        pick = F.max_by(F.struct("complexity", "sig"), order).alias(tag)
        return df.where(F.col("name").isNotNull()).groupBy("name").agg(pick)

    both = last(a, "a").join(last(b, "b"), "name", "full_outer")
    alike = similarity(F.col("a.sig"), F.col("b.sig"))
    weak = (F.col("a.complexity") < C.MIN_COMPLEXITY) | (F.col("b.complexity") < C.MIN_COMPLEXITY)
    status = (
        F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(weak, "low_signal")
        .when(alike >= C.SAME_THRESHOLD, "same").otherwise("changed")
    )
    out = both.select("name", status.alias("status"), alike.alias("similarity"))
    return out.withColumn("similarity", F.when(F.col("status").isin("same", "changed"), F.col("similarity")))


def match_summary(match: DataFrame) -> DataFrame:
    """One row: compared, same, changed, low_signal, only_a, only_b. compared is same + changed + low_signal."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), True))
    kinds = ("same", "changed", "low_signal", "only_a", "only_b")
    return match.agg(n("same", "changed", "low_signal").alias("compared"), *(n(k).alias(k) for k in kinds))


def match_changed(match: DataFrame, limit: int | None = C.CHANGES_SHOWN) -> DataFrame:
    """Changed names, least similar first, as many as the report shows."""
    out = match.where("status = 'changed'").select("name", "similarity").orderBy("similarity", "name")
    return out if limit is None else out.limit(limit)


def match_only(match: DataFrame, side: str) -> DataFrame:
    """Names on one side only (``a`` or ``b``), sorted."""
    return match.where(F.col("status") == f"only_{side}").select("name").orderBy("name")


# ---- query -----------------------------------------------------------------------------------------------------------


def query(target: DataFrame, corpus: DataFrame, threshold: float = C.QUERY_THRESHOLD) -> DataFrame:
    """``id, entry, guess, from_binary, similarity`` of the targets whose best match reaches ``threshold``; most similar first."""
    best = best_match(target, corpus).where(F.col("similarity") >= threshold)
    out = target.select("id", "entry").join(best, "id").select("id", "entry", "guess", "from_binary", "similarity")
    return out.orderBy(F.col("similarity").desc(), unsigned_order(F.col("entry")), "id")


# ---- triage ----------------------------------------------------------------------------------------------------------


def verdict(vuln: Column, patched: Column, min_similarity: float, margin: float) -> Column:
    """Neither side close enough comes first, then the vulnerable lead, then the patched one; a lead of just ``margin`` counts."""
    slots = round(margin * C.SLOTS * 1e6) / 1e6
    lead = (vuln - patched) * C.SLOTS  # whole slots, so the bound is met exactly
    return (
        F.when(F.greatest(vuln, patched) < min_similarity, "inconclusive")
        .when(lead >= slots, "vulnerable").when(-lead >= slots, "patched").otherwise("inconclusive")
    )


def triage(
    target: DataFrame, vuln: DataFrame, patched: DataFrame,
    min_similarity: float = C.TRIAGE_MIN_SIMILARITY, margin: float = C.TRIAGE_MARGIN,
) -> DataFrame:
    """Every target with enough signal against both corpora, as a review queue.

    Returns ``id, entry, verdict, vuln_similarity, vuln_name, patched_similarity, patched_name, lead``; a side without match
    has similarity 0 and an empty name.
    """
    rows = well_formed(target).where(has_signal()).select("id", "entry")
    for tag, best in zip(("vuln", "patched"), best_in_each(target, (vuln, patched))):
        best = best.select("id", F.col("similarity").alias(f"{tag}_similarity"), F.col("guess").alias(f"{tag}_name"))
        rows = rows.join(best, "id", "left").fillna(0.0, [f"{tag}_similarity"]).fillna("", [f"{tag}_name"])
    v, p = F.col("vuln_similarity"), F.col("patched_similarity")
    out = rows.withColumns({"verdict": verdict(v, p, min_similarity, margin), "lead": v - p})
    place = F.when(F.col("verdict") == "vulnerable", 0).when(F.col("verdict") == "inconclusive", 1).otherwise(2)
    return out.orderBy(place, v.desc(), unsigned_order(F.col("entry")), "id")


def triage_counts(hits: DataFrame) -> DataFrame:
    """One row: triaged, vulnerable, patched, inconclusive."""
    n = lambda s: F.count(F.when(F.col("verdict") == s, True)).alias(s)
    return hits.agg(F.count(F.lit(1)).alias("triaged"), n("vulnerable"), n("patched"), n("inconclusive"))


def review_queue(hits: DataFrame) -> DataFrame:
    """Targets that lean to the vulnerable side, strongest first."""
    return hits.where("verdict = 'vulnerable'").orderBy(F.col("vuln_similarity").desc(), unsigned_order(F.col("entry")), "id")


# ---- evaluate --------------------------------------------------------------------------------------------------------


def evaluate_ranks(a: DataFrame, b: DataFrame, order: str = "id") -> DataFrame:
    """Every named row of A with enough signal and a namesake in B, ranked against all of B by similarity.

    Returns ``id, name, rank, top_name, top_similarity``. Ties keep B's order (``order``); ``rank`` is the place of the first
    namesake. Nothing is deduplicated. A is the query set and passes all of B in blocks. Building the plan runs jobs.
    """
    rows_b = well_formed(b).where(is_known() & (F.col("shingles") > 0))
    rows_a = well_formed(a).where(is_known() & has_signal()).join(rows_b.select("name").distinct(), "name", "left_semi")
    places = number_rows(rows_b.select("name", "sig", F.col(order).alias("_o"), F.col("id").alias("_id")), "_o", "_id").select("name", "sig", "place")

    # the best namesake sets the bar; names are tags, so that a name that very many rows share makes no pairs
    tag = F.xxhash64("name").alias("tag")
    best = best_with_tag(rows_a.select(F.col("id").alias("q"), "sig", tag), places.select("place", "sig", tag), stored=True)
    bars = best.select("q", F.col("equal").alias("bar"), F.col("place").alias("bar_place"))
    asked = rows_a.select(F.col("id").alias("q"), "sig").join(bars, "q")
    seen = against_all(asked, places.select("place", "sig"), stored=True)
    named = seen.join(places.select(F.col("place").alias("top_place"), F.col("name").alias("top_name")), "top_place")
    named = named.join(rows_a.select(F.col("id").alias("q"), "name"), "q")
    alike = (F.col("top_equal") / F.lit(C.SLOTS)).alias("top_similarity")
    return named.select(F.col("q").alias("id"), "name", (F.col("ahead") + 1).alias("rank"), "top_name", alike)


def evaluate(ranks: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """One row of accuracy figures; all ratios are 0 where nothing was scored."""
    same = F.col("top_similarity") >= C.SAME_THRESHOLD
    right = F.col("top_name") == F.col("name")
    n = lambda test: F.count(F.when(test, True))
    sums = ranks.agg(
        F.count(F.lit(1)).alias("scored"), n(right).alias("rank1"), F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)).alias("_rr"),
        n(same & right).alias("tp"), n(same & ~right).alias("fp"), n(~same & right).alias("fn"), n(~same).alias("abstained"),
        *(n(F.col("rank") <= k).alias(f"_at_{k}") for k in ks),
    )
    s = F.col("scored")
    return sums.select(
        "scored", "rank1", "tp", "fp", "fn", "abstained",
        _ratio(F.col("rank1"), s).alias("rank1_accuracy"), _ratio(F.col("_rr"), s).alias("mrr"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        *(_ratio(F.col(f"_at_{k}"), s).alias(f"recall_at_{k}") for k in ks), _ratio(F.col("abstained"), s).alias("abstain_rate"),
    )


# ---- dump ------------------------------------------------------------------------------------------------------------


def dump(traces: DataFrame, funcs: DataFrame, name: str) -> DataFrame:
    """``path, line_no, line``: the traces of the first function of that name (lowest entry), one line per effect after a header."""
    first = funcs.where(F.col("name") == name).orderBy(unsigned_order(F.col("entry")), "id").limit(1).select(F.col("id").alias("func_id"))
    runs = traces.join(F.broadcast(first), "func_id").select("func_id", "trace_id", "seed_ix", "effects", "instret", "capped")
    path = F.row_number().over(Window.partitionBy("func_id").orderBy("seed_ix", "trace_id")) - 1
    runs = runs.withColumn("path", path).withColumn("_e", F.coalesce(in_order(F.col("effects")), F.array().cast(runs.schema["effects"].dataType)))
    # fixed value: the form of the header
    head = F.format_string("-- path %d (%d effects, instret %d, capped %s) --", "path", F.size("_e"), "instret", F.col("capped").cast("string"))
    lines = F.concat(F.array(head), F.transform("_e", lambda e: F.concat(F.lit("   "), render.effect_text(e))))
    return runs.select("path", F.posexplode(lines).alias("line_no", "line")).withColumn("line", render.escape(F.col("line")))
