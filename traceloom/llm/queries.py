"""Queries of the training-data operators, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import near_duplicates, neighbours, packing, repetition, runs, subsequences, tokenize, top_n
from traceloom.operators.shared import materialize


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_table(spark, sf, "funcs"))


def p1_class_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicate_class_pairs(_table(spark, sf, "funcs"))


def p1_links(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicate_links(_table(spark, sf, "funcs"))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_table(spark, sf, "funcs"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return top_n.top_guesses(_table(spark, sf, "named")).select("named_id")


def p2_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return top_n.top_guesses(_table(spark, sf, "named"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest_rows(_table(spark, sf, "funcs")).select("id", "neighbour_id")


def p3_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the index gives nine tenths of the exact result, for the ids divisible by 100 against all rows."""
    return neighbours.recall(_table(spark, sf, "funcs")).select("queries", "wanted", "enough")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return subsequences.frequent_subsequences(_table(spark, sf, "traces")).select("pattern")


def p4_supports(spark: SparkSession, sf: str) -> DataFrame:
    return subsequences.frequent_subsequences(_table(spark, sf, "traces"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return runs.collapse_runs(_table(spark, sf, "traces"), least=3).select("trace_id", "first_seq", "last_seq")


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Every effect stream with its runs collapsed, runs of one effect included."""
    return runs.collapse_runs(_table(spark, sf, "traces"), least=1)


def p5_event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """As ``p5_collapsed``, from one row per event with every trace cut into chunks."""
    events = _table(spark, sf, "traces").select("trace_id", F.inline("effects"))
    out = runs.collapse_event_rows(events)
    return out.withColumns({c: F.col(c).cast("int") for c in ("first_seq", "last_seq")})


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode_ids(_table(spark, sf, "documents"))


def p7_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Per document where its tokens begin and end in characters, and how many tokens don't follow the one before."""
    spans = tokenize.encode_offsets(_table(spark, sf, "documents"))
    # a token may begin inside the character that the one before ends in
    gaps = F.filter(F.arrays_zip(F.slice("starts", 2, F.size("starts")).alias("a"), F.col("ends").alias("b")), lambda x: (x["a"] > x["b"]) | (x["a"] < x["b"] - 1))
    zero = F.lit(0)
    return spans.select(
        "doc_id", F.coalesce(F.array_min("starts"), zero).alias("first_char"), F.coalesce(F.array_max("ends"), zero).cast("long").alias("last_char"), F.size(gaps).alias("gaps")
    )


def p7_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose decoded ids differ from their text; none for texts that are UTF-8."""
    docs = _table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("was"))
    back = tokenize.decode_ids(tokenize.encode_ids(_table(spark, sf, "documents")))
    return docs.join(back, "doc_id").where("was <> text").select("doc_id")


def _standard(spark: SparkSession, sf: str) -> int:
    kinds = _table(spark, sf, "containers").where("container_kind = 'standard'")
    return int(kinds.agg(F.max("capacity_tokens")).first()[0])


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), _standard(spark, sf))


def p8_in_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """Batches formed strictly inside their buckets."""
    return packing.pack_documents(_table(spark, sf, "documents"), _standard(spark, sf), top_up=False)


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Fill of the containers, with batches that top up from shorter buckets and strictly inside buckets."""
    capacity, docs = _standard(spark, sf), _table(spark, sf, "documents")
    sizes = materialize(tokenize.count_tokens(docs), "sizes")
    both = [packing.fill_report(packing.pack(sizes, capacity, top_up=up), capacity).select(F.lit(name).alias("batches"), "*") for name, up in (("top_up", True), ("in_bucket", False))]
    return both[0].unionByName(both[1])


def p8_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of what a whole packing must not have, over both ways of batching."""
    capacity, docs = _standard(spark, sf), _table(spark, sf, "documents")
    sizes = materialize(tokenize.count_tokens(docs), "sizes")
    both = [packing.broken_rules(docs, packing.pack(sizes, capacity, top_up=up), capacity).select(F.lit(name).alias("batches"), "*") for name, up in (("top_up", True), ("in_bucket", False))]
    return both[0].unionByName(both[1])


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repeated_documents(_table(spark, sf, "documents")).select("doc_id")


def p9_measures(spark: SparkSession, sf: str) -> DataFrame:
    """All measures of every document and the rules that it breaks."""
    return repetition.measure(_table(spark, sf, "documents")).withColumn("broken", F.array_join("broken", ","))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: (x[0].split("_")[0], not x[0].endswith("_found"), x[0])))
