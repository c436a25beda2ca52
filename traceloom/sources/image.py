"""Corpus images: SQLite files that hold a ``funcs`` and a ``bands`` table."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.functions import arrow
from traceloom.functions.signature import np_band_keys
from traceloom.operators.corpus import FUNCS, well_formed

# Layout of the image's tables.
_TABLES = """
CREATE TABLE IF NOT EXISTS funcs(id INTEGER PRIMARY KEY, binary TEXT NOT NULL, name TEXT, entry INTEGER NOT NULL, source TEXT NOT NULL,
  complexity INTEGER NOT NULL, shingles INTEGER NOT NULL, capped INTEGER NOT NULL, sig BLOB NOT NULL);
CREATE TABLE IF NOT EXISTS bands(band INTEGER NOT NULL, key INTEGER NOT NULL, func_id INTEGER NOT NULL);
"""
_INDEX = "CREATE INDEX IF NOT EXISTS bands_lookup ON bands(band, key);\n"
DDL = _TABLES + _INDEX

IMAGES = "part int, piece int, functions bigint, image binary"

_COLUMNS = [c.split()[0] for c in FUNCS.split(", ")]
#: Bytes at which ``images`` ends an image and begins the next; a function's bytes in it besides its texts, rounded up.
IMAGE_BYTES = 1 << 20
_FUNCTION_BYTES = C.SLOTS * 8 + C.BANDS * 48
#: Functions and bytes after which a batch of what is read is passed on.
_BATCH, _BATCH_BYTES = 2000, 8 << 20


class BadImage(ValueError):
    """The bytes aren't a corpus image."""


def _read(image: bytes | memoryview) -> Iterator[list[tuple]]:
    """Well-formed functions of an image in bounded lists: its columns and the bytes of the texts. The image is opened in
    memory and read-only; nothing in it is executed."""
    if bytes(image[:16]) != b"SQLite format 3\0":
        raise BadImage("not a SQLite image")
    if len(image) > C.MAX_FILE:
        raise BadImage("the image is over the size limit")
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(image)
        con.execute("PRAGMA query_only = 1")
        con.execute("PRAGMA temp_store = MEMORY")
        texts = " + ".join(f"coalesce(length(CAST({c} AS BLOB)), 0)" for c in ("binary", "name", "source"))
        found = con.execute(
            f"SELECT id, binary, name, entry, source, complexity, shingles, capped, sig, {texts} FROM funcs WHERE typeof(sig) = 'blob' AND length(sig) = ? "
            "AND length(binary) <= ? AND (name IS NULL OR length(name) <= ?) AND length(source) <= ?",
            (C.SLOTS * 8, C.MAX_TEXT, C.MAX_TEXT, C.MAX_TEXT),
        )
        held, size = [], 0
        for r in found:
            held.append(r)
            size += C.SLOTS * 8 + r[9]
            if len(held) >= _BATCH or size >= _BATCH_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held
    except (sqlite3.Error, OverflowError) as e:
        raise BadImage(str(e)) from e
    finally:
        con.close()


def rows(image: bytes) -> list[dict]:
    """All well-formed functions of an image."""
    return [dict(zip(_COLUMNS, r)) | {"capped": bool(r[7]), "sig": np.frombuffer(r[8], "<i8").tolist()} for part in _read(image) for r in part]


def _batch(part: list[tuple]) -> pa.RecordBatch:
    schema, columns = arrow.schema(FUNCS), list(zip(*part))
    columns[7] = [bool(x) for x in columns[7]]
    sigs = np.frombuffer(b"".join(columns[8]), "<i8")
    arrays = [pa.array(list(x), t.type) for x, t in zip(columns[:8], schema)]
    lists = pa.ListArray.from_arrays(np.arange(0, len(sigs) + 1, C.SLOTS, dtype=np.int32), sigs)
    return pa.RecordBatch.from_arrays([*arrays, lists], schema=schema)


def _parsed(image: bytes | memoryview) -> Iterator[pa.RecordBatch]:
    return map(_batch, _read(image))


def parse_images(files: DataFrame) -> DataFrame:
    """Functions of all images (``content``), as ``rows`` gives them. Besides one image a worker holds one batch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from _parsed(memoryview(content.as_buffer()))

    return files.select("content").mapInArrow(run, FUNCS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Functions of the images at ``path``; ``bands`` are derived again where they are needed, the stored ones aren't read."""
    return parse_images(spark.read.format("binaryFile").load(path))


def _write(fields: list[list], sigs: np.ndarray) -> bytes:
    """An image of functions: their columns between ``id`` and ``sig``, and (n, 128) signatures."""
    n, blobs = len(sigs), memoryview(sigs.astype("<i8").tobytes())
    con = sqlite3.connect(":memory:")
    con.executescript(_TABLES)
    cut = (blobs[k : k + C.SLOTS * 8] for k in range(0, len(blobs), C.SLOTS * 8))
    con.executemany(
        "INSERT INTO funcs(id, binary, name, entry, source, complexity, shingles, capped, sig) VALUES(?, ?, ?, ?, ?, ?, ?, ?, ?)",
        zip(range(1, n + 1), *fields[:-1], map(int, fields[-1]), cut, strict=True),
    )
    keys = np_band_keys(sigs.view(np.uint64)).view(np.int64).reshape(-1).tolist()
    band, owner = np.tile(np.arange(C.BANDS), n).tolist(), np.repeat(np.arange(1, n + 1), C.BANDS).tolist()
    con.executemany("INSERT INTO bands(band, key, func_id) VALUES(?, ?, ?)", zip(band, keys, owner, strict=True))
    con.commit()
    con.executescript(_INDEX)  # of all rows at once, which takes less time and fewer pages than row by row
    image = con.serialize()
    con.close()
    return image


def build(records: list[dict]) -> bytes:
    """An image of functions (fields of ``funcs``); ids are given by the image in the order of the records."""
    sigs = np.array([r["sig"] for r in records], np.int64).reshape(len(records), C.SLOTS)
    return _write([[r[c] for r in records] for c in _COLUMNS[1:-1]], sigs)


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows whose images reach ``most`` bytes with their last function, in order; the last run may be shorter."""
    held, size = [], 0
    for b in batches:
        texts = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("binary", "name", "source"))
        upto, at, before = np.cumsum(texts + _FUNCTION_BYTES), 0, 0
        while at < b.num_rows:
            end = min(int(np.searchsorted(upto, before + most - size)) + 1, b.num_rows)
            held.append(b.slice(at, end - at))
            size += int(upto[end - 1]) - before
            at, before = end, int(upto[end - 1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _written(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, bytes]]:
    """Partition, number of functions and bytes of one image after the other."""
    for held in _pieces(batches, most):
        fields = [[x for b in held for x in b.column(c).to_pylist()] for c in _COLUMNS[1:-1]]
        sigs = np.concatenate([b.column("sig").flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(-1, C.SLOTS)
        yield held[0].column("_p")[0].as_py(), len(sigs), _write(fields, sigs)


def _ordered(funcs: DataFrame) -> DataFrame:
    return well_formed(funcs).select(*_COLUMNS, F.spark_partition_id().alias("_p")).sortWithinPartitions("id")


def images(funcs: DataFrame, most: int = IMAGE_BYTES) -> DataFrame:
    """``part, piece, functions, image``: well-formed rows in the order of ``id``, per partition of ``funcs`` as many images as it
    takes for each to stay at about ``most`` bytes. Parquet writers hold a hundred images and more at a time; none may be
    larger than ``MAX_FILE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, (part, n, image) in enumerate(_written(batches, most)):
            yield pa.RecordBatch.from_pylist([{"part": part, "piece": piece, "functions": n, "image": image}], arrow.schema(IMAGES))

    return _ordered(funcs).mapInArrow(run, IMAGES)


def round_trip(funcs: DataFrame, most: int = IMAGE_BYTES) -> DataFrame:
    """As ``parse_images`` of ``images``: each image is read as soon as it is written, by the same worker, so that one lies in
    memory at a time. Between two operators Spark gathers 64 MB of images per task, in the JVM and in Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, image in _written(batches, most):
            yield from _parsed(image)

    return _ordered(funcs).mapInArrow(run, FUNCS)
