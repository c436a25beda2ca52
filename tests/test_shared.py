import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from traceloom.operators import numbering, shared
from traceloom.sources import elf


def test_places_follow_the_order(spark):
    df = spark.range(0, 5000, 1, 7).select(F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(900))).alias("k"), "id")
    rows = numbering.number_rows(df, "k", "id").collect()
    want = sorted(df.collect(), key=lambda r: (r.k is not None, r.k or 0, r.id))
    assert [r.id for r in sorted(rows, key=lambda r: r.place)] == [r.id for r in want] and sorted(r.place for r in rows) == list(range(1, 5001))
    down = numbering.number_as_is(df.orderBy(F.col("id").desc())).orderBy("place").collect()
    assert [r.id for r in down] == list(range(4999, -1, -1))
    assert numbering.number_rows(df.limit(0), "k").count() == 0


def test_stored_tables_can_be_discarded(spark):
    table, path = shared.store(spark.range(5), "kept")
    at = path.removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(at)
    shared.discard(spark, path)
    assert not os.path.isdir(at)


def test_stored_tables_go_when_the_application_ends(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from traceloom.operators.shared import materialize
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.ui.enabled", "false").getOrCreate()
print(materialize(spark.range(3), "rows").count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["3"], done.stderr
    left = [f for _, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet")]
    assert left == []


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"

    class Session:
        class conf:
            @staticmethod
            def get(name, other):
                return other

        sparkContext = Context

    with pytest.raises(ValueError):
        shared.shared_dir(Session)


def test_small_scans_are_spread(spark):
    one = spark.range(0, 10, 1, 1)
    assert shared.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert shared.spread(spark.range(0, 10, 1, 9)).rdd.getNumPartitions() == 9


def test_pages_and_bytes_of_segments(spark):
    top = -4096
    rows = [("a", 0x1000, 1), ("a", 0x1FFF, 2), ("a", 0x5000, 0), ("a", 0x4FFF, 0x2001), ("b", top, 4096), ("b", -1, 100), ("b", 5, 10), (None, 7, None)]
    got = {(r.binary, r["first"], r.n_pages) for r in elf.mapped_pages(spark.createDataFrame(rows, "binary string, vaddr bigint, mem_size bigint")).collect()}
    assert got == {("a", 0x1000, 2), ("a", 0x4000, 3), ("b", 0, 1), ("b", top, 1)}
    segments = spark.createDataFrame([(bytearray(b"\1\2"), 5), (bytearray(b""), 2)], "bytes binary, mem_size bigint")
    assert [bytes(r.bytes) for r in elf.whole_bytes(segments).collect()] == [b"\1\2\0\0\0", b"\0\0"]
    calls = spark.createDataFrame([("x", 5), ("x", 5), ("y", 5), ("x", 99)], "binary string, addr bigint")
    held = spark.createDataFrame([("x", 0, 10, 1), ("x", 4, 10, 0), ("z", 0, 100, 0)], "binary string, vaddr bigint, mem_size bigint, segment int")
    assert sorted((r.binary, r.addr, r.segment, r.in_segment) for r in elf.in_segments(calls, held).collect() if r.segment is not None) == [("x", 5, 0, True)] * 2
    assert elf.in_segments(calls, held).where("NOT in_segment").count() == 2
