"""A corpus of fingerprinted functions: the ``funcs`` table and its band index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.functions.signature import np_band_keys
from traceloom.operators.shared import materialize

FUNCS = "id bigint, binary string, name string, entry bigint, source string, complexity bigint, shingles bigint, capped boolean, sig array<bigint>"
BANDS = "func_id bigint, band int, key bigint"


def is_well_formed() -> Column:
    """Rows that a reader may trust: 128 slots without nulls, text fields of at most 1 MiB, only the name may be null."""
    short = [F.length(c) <= C.MAX_TEXT for c in ("binary", "source")]
    name = F.col("name").isNull() | (F.length("name") <= C.MAX_TEXT)
    sig = (F.size("sig") == C.SLOTS) & ~F.exists("sig", lambda x: x.isNull())
    return F.coalesce(sig & short[0] & short[1] & name, F.lit(False))


def well_formed(funcs: DataFrame) -> DataFrame:
    """Rows that aren't well formed are skipped."""
    return funcs.where(is_well_formed())


def checked(funcs: DataFrame) -> DataFrame:
    """Rows as they are; a signature of another length stops the query with an error when it is read."""
    bad = F.raise_error(F.concat(F.lit("signature of wrong length in row "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    return funcs.withColumn("sig", F.when(F.size("sig") == C.SLOTS, F.col("sig")).otherwise(bad.cast("array<bigint>")))


def has_signal() -> Column:
    """Enough behaviour to be looked up."""
    return (F.col("complexity") >= C.MIN_COMPLEXITY) & (F.col("shingles") != 0)


def is_known() -> Column:
    """Enough behaviour and a name to be found."""
    return (F.col("complexity") >= C.MIN_COMPLEXITY) & F.col("name").isNotNull()


def derive_bands(funcs: DataFrame) -> DataFrame:
    """``func_id, band, key`` for all 32 bands of each row of ``id, sig``; rows without 128 slots give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sigs = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, C.SLOTS)
            keys = np_band_keys(sigs).reshape(-1).view(np.int64)
            band = np.tile(np.arange(C.BANDS, dtype=np.int32), n)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(n), C.BANDS)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(band), pa.array(keys)], ["func_id", "band", "key"])

    whole = funcs.where((F.size("sig") == C.SLOTS) & ~F.exists("sig", lambda x: x.isNull()))
    return whole.select(F.col("id").cast("long").alias("id"), "sig").mapInArrow(run, BANDS)


@dataclass(frozen=True)
class Corpus:
    """Functions and the band index derived from their signatures. Reports never trust stored bands; ``stored`` holds
    those of a corpus on disk, for lookups by ``matching.stored_candidates``."""

    funcs: DataFrame
    stored: DataFrame | None = None

    @classmethod
    def of(cls, funcs: DataFrame) -> Corpus:
        return cls(well_formed(funcs))

    @property
    def bands(self) -> DataFrame:
        return derive_bands(self.funcs)

    def size(self) -> int:
        return self.funcs.count()

    def is_empty(self) -> bool:
        return self.funcs.isEmpty()

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Corpus:
        bands = spark.read.schema(BANDS).parquet(f"{path}/bands")
        return cls(well_formed(spark.read.parquet(f"{path}/funcs")), bands)

    def write(self, path: str) -> None:
        """``path/funcs`` and ``path/bands`` anew; see ``append`` for more rows."""
        self.funcs.write.mode("overwrite").parquet(f"{path}/funcs")
        _write_bands(self.bands, path, "overwrite")


def _write_bands(bands: DataFrame, path: str, mode: str) -> None:
    """One folder per band, sorted by key, so that a lookup of some bands and keys reads few row groups. The ranges follow
    the data's size, so small appends write few files."""
    placed = bands.repartitionByRange("band", "key").sortWithinPartitions("band", "key")
    placed.write.mode(mode).partitionBy("band").parquet(f"{path}/bands")


def append(spark: SparkSession, path: str, fingerprints: DataFrame) -> int:
    """Append fingerprints without ids to a stored corpus, creating it if it is missing; gives the number of rows written.

    Nothing is deduplicated; rows that aren't well formed are skipped. New ids are larger than all old ones and grow in
    the order of the input's partitions; they may have gaps, which keeps the numbering free of a global sort. The numbered
    rows are stored once and both tables are written from them, bands first: what a failure leaves is a band of an id
    that no function has, which lookups skip and later ids don't reuse. One writer at a time.
    """
    from pyspark.errors import AnalysisException

    last = 0
    for table, column in (("funcs", "id"), ("bands", "func_id")):
        try:
            last = max(last, spark.read.parquet(f"{path}/{table}").agg(F.max(column)).first()[0] or 0)
        except AnalysisException:  # no such table yet
            continue
    cols = [c.split()[0] for c in FUNCS.split(", ")]
    numbered = well_formed(fingerprints.withColumn("id", F.lit(None).cast("long"))).withColumn("id", F.monotonically_increasing_id() + F.lit(last + 1))
    rows = materialize(numbered.select(*cols), "numbered")
    _write_bands(derive_bands(rows), path, "append")
    rows.write.mode("append").parquet(f"{path}/funcs")
    return rows.count()


def stale_bands(funcs: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored band rows that the signatures don't give: keys out of date, unknown functions. Each distinct row once."""
    return stored.select("func_id", "band", "key").distinct().join(derive_bands(funcs), ["func_id", "band", "key"], "left_anti")


def missing_bands(funcs: DataFrame, stored: DataFrame) -> DataFrame:
    """Band rows that the signatures give and that aren't stored."""
    return derive_bands(funcs).join(stored.select("func_id", "band", "key").distinct(), ["func_id", "band", "key"], "left_anti")


def index_summary(funcs: DataFrame, by: str | None = "binary") -> DataFrame:
    """Functions, named ones and ones with enough signal, per ``by`` or over all."""
    counts = (
        F.count(F.lit(1)).alias("functions"), F.count("name").alias("named"),
        F.count(F.when(F.col("complexity") >= C.MIN_COMPLEXITY, True)).alias("usable"),
    )
    return funcs.groupBy(*([by] if by else [])).agg(*counts)
