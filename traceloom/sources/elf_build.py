"""Small ELF files with given symbols, unwind records and segments, for round trips through the reader."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import arrow
from traceloom.sources.elf import DYNSYM, FUNC, LOAD, MACHINE_X86_64, SYMTAB

STRINGS, BYTES = 3, 1
CODE = 0x401000
Symbol = tuple[str | None, int, int, int]  # name, value, size, kind


def _symbols(symbols: Sequence[Symbol], names: bytearray) -> bytes:
    out = [bytes(24)]
    for name, value, size, kind in symbols:
        at = len(names) if name else 0
        if name:
            names += name.encode() + b"\0"
        out.append(struct.pack("<IBBHQQ", at, kind, 0, 1, value & (1 << 64) - 1, size & (1 << 64) - 1))
    return b"".join(out)


def unwind_records(functions: Sequence[tuple[int, int]]) -> bytes:
    """A common record with absolute pointers and a frame record for each (entry, size)."""
    common = struct.pack("<I", 0) + b"\1zR\0" + b"\1\x78\x10\1\0" + bytes(3)
    out = bytearray(struct.pack("<I", len(common)) + common)
    for entry, size in functions:
        here = len(out) + 4
        out += struct.pack("<IIQQ", 24, here, entry & (1 << 64) - 1, size & (1 << 64) - 1) + bytes(4)
    return bytes(out + struct.pack("<I", 0))


def build(
    symbols: Sequence[Symbol] = (), dynamic: Sequence[Symbol] = (), loads: Sequence[tuple[int, int]] = ((CODE, 0x2000),), unwind: bytes = b"", machine: int = MACHINE_X86_64,
    unwind_at: int = 0x500000,
) -> bytes:
    """Header, program headers (one per load of address and memory size), code, tables and section headers."""
    names = bytearray(b"\0")
    tables = [_symbols(group, names) for group in (symbols, dynamic)]
    section_names = b"\0.eh_frame\0.rest\0"
    at, offsets, blob = 64 + 56 * len(loads), [], bytearray()
    for part in (b"\x90" * 64, bytes(names), *tables, unwind, section_names):
        offsets.append(at + len(blob))
        blob += part
    programs = b"".join(struct.pack("<IIQQQQQQ", LOAD, 5, offsets[0], v, v, min(64, m), m, 4096) for v, m in loads)
    section = struct.Struct("<IIQQQQIIQQ")
    sections = [section.pack(*[0] * 10), section.pack(11, STRINGS, 0, 0, offsets[1], len(names), 0, 0, 1, 0)]
    for kind, group, place, table in ((SYMTAB, symbols, offsets[2], tables[0]), (DYNSYM, dynamic, offsets[3], tables[1])):
        if group:
            sections.append(section.pack(11, kind, 0, 0, place, len(table), 1, 0, 8, 24))
    sections.append(section.pack(1, BYTES, 2, unwind_at, offsets[4], len(unwind), 0, 0, 8, 0))
    sections.append(section.pack(11, STRINGS, 0, 0, offsets[5], len(section_names), 0, 0, 1, 0))
    n = len(sections)
    head = b"\x7fELF\2\1\1" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, machine, 1, CODE, 64, at + len(blob), 0, 64, 56, len(loads), 64, n, n - 1)
    return b"".join((head, programs, blob, *sections))


def files(functions: DataFrame, loads: Column | None = None, machine: Column | None = None) -> DataFrame:
    """``path, content``: one file per ``binary`` from rows ``binary, id, name, entry, size, source``.

    A binary without any name is stripped: its functions are unwind records. Otherwise rows of source ``dynsym`` are dynamic
    symbols and all others symbols, in the order of ``id``. ``loads`` (array of vaddr and size) and ``machine`` may depend on
    ``binary``. A file is one row, so a binary's functions meet in one task, as they do in the file itself.
    """
    item = F.struct("id", "name", "entry", "size", "source")
    per = functions.groupBy("binary").agg(F.array_sort(F.collect_list(item)).alias("f"))
    one = F.array(F.struct(F.lit(CODE).cast("long").alias("vaddr"), F.lit(0x2000).cast("long").alias("size")))
    rows = per.select("binary", "f", (one if loads is None else loads).alias("loads"), (F.lit(MACHINE_X86_64) if machine is None else machine).alias("machine"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                stripped = all(f["name"] is None for f in r["f"])
                table = {d: [(f["name"], f["entry"], f["size"], FUNC) for f in r["f"] if (f["source"] == "dynsym") == d] for d in (False, True)}
                unwind = unwind_records([(f["entry"], f["size"]) for f in r["f"]]) if stripped else b""
                symbols = ([], []) if stripped else (table[False], table[True])
                made = build(*symbols, [(x["vaddr"] & (1 << 64) - 1, x["size"] & (1 << 64) - 1) for x in r["loads"]], unwind, r["machine"])
                yield pa.RecordBatch.from_pylist([{"path": r["binary"], "content": made}], arrow.schema("path string, content binary"))

    return rows.mapInArrow(run, "path string, content binary")
