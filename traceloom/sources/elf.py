"""Functions and segments of x86-64 ELF files.

Files are read by Spark's ``binaryFile`` source and parsed one per row in Arrow batches. Everything in a file is
untrusted: sizes and offsets are checked before anything is sliced or allocated.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.functions.hashing import unsigned_order
from traceloom.operators.shared import materialize

FUNCTIONS = "binary string, name string, entry bigint, size bigint, source string"
SEGMENTS = "binary string, segment int, vaddr bigint, bytes binary, mem_size bigint, exec boolean, write boolean"

# Numbers of the ELF format and of unwind records.
MACHINE_X86_64, LOAD, DYNAMIC, SYMTAB, DYNSYM, FUNC = 62, 1, 2, 2, 11, 2
EXEC, WRITE = 1, 2
DT_HASH, DT_STRTAB, DT_SYMTAB, DT_STRSZ, DT_GNU_HASH = 4, 5, 6, 10, 0x6FFFFEF5


class BadElf(ValueError):
    """The file isn't an ELF file that this reader takes."""


@dataclass
class Elf:
    segments: list[dict] = field(default_factory=list)
    functions: list[dict] = field(default_factory=list)


def _table(data: bytes, at: int, entry: int, count: int, form: str, what: str) -> list[tuple]:
    size = struct.calcsize(form)
    if count and (entry < size or at + entry * count > len(data)):
        raise BadElf(f"{what} lie outside the file")
    return [struct.unpack_from(form, data, at + entry * k) for k in range(count)]


def _text(blob: bytes, at: int) -> str | None:
    """Name at an offset of a string table; None if it is empty, unreadable or outside."""
    end = blob.find(b"\0", at) if 0 <= at < len(blob) else -1
    try:
        return (blob[at:end].decode() or None) if end > at else None
    except UnicodeDecodeError:
        return None


def _load_segments(data: bytes, headers: list[tuple]) -> list[dict]:
    out, total = [], 0
    for kind, flags, offset, vaddr, _, filesz, memsz, _ in headers:
        if kind != LOAD:
            continue
        if memsz > C.MAX_SEGMENT:
            raise BadElf(f"a segment of {memsz} bytes is over the limit")
        if vaddr + memsz >= 1 << 64:
            raise BadElf("a segment runs past the address space")
        first = min(offset, len(data))
        last = min(first + filesz, len(data))
        size = max(last - first, memsz)
        total += size
        if total > C.MAX_SEGMENTS_TOTAL:
            raise BadElf("the segments together are over the limit")
        out.append({"vaddr": C.signed(vaddr), "_cut": (first, last), "mem_size": size, "exec": bool(flags & EXEC), "write": bool(flags & WRITE)})
    if not out:
        raise BadElf("no segment is loaded")
    for s in out:  # only now, when the sum is known to be bounded
        first, last = s.pop("_cut")
        s["bytes"] = data[first:last]
    return out


def _file_place(addr: int, headers: list[tuple]) -> int | None:
    for kind, _, offset, vaddr, _, filesz, _, _ in headers:
        if kind == LOAD and vaddr <= addr < vaddr + filesz:
            return offset + addr - vaddr
    return None


def _dynamic_symbols(data: bytes, headers: list[tuple]) -> tuple[int, int, bytes] | None:
    """Place and number of the dynamic symbols and their names, by the dynamic segment."""
    found = next((h for h in headers if h[0] == DYNAMIC), None)
    if found is None:
        return None
    tags: dict[int, int] = {}
    for at in range(found[2], min(found[2] + found[5], len(data)) - 15, 16):
        tag, value = struct.unpack_from("<QQ", data, at)
        if tag == 0:
            break
        tags.setdefault(tag, value)
    symbols, names = (_file_place(tags[t], headers) if t in tags else None for t in (DT_SYMTAB, DT_STRTAB))
    if symbols is None or names is None:
        return None
    count = 0
    table = _file_place(tags[DT_HASH], headers) if DT_HASH in tags else None
    gnu = _file_place(tags[DT_GNU_HASH], headers) if DT_GNU_HASH in tags else None
    try:
        if table is not None:
            count = struct.unpack_from("<II", data, table)[1]
        elif gnu is not None:
            buckets, first, bloom, _ = struct.unpack_from("<IIII", data, gnu)
            at = gnu + 16 + 8 * bloom
            count = max(struct.unpack_from(f"<{buckets}I", data, at), default=0)
            chain = at + 4 * buckets
            while count >= first and not struct.unpack_from("<I", data, chain + 4 * (count - first))[0] & 1:
                count += 1
            count = count + 1 if count >= first else 0
    except struct.error:
        return None
    return symbols, min(count, max(0, len(data) - symbols) // 24), data[names : names + tags.get(DT_STRSZ, 0)]


def _symbols(data: bytes, at: int, count: int, names: bytes, source: str) -> list[dict]:
    out = []
    for name, info, _, _, value, size in _table(data, at, 24, count, "<IBBHQQ", "symbols"):
        if info & 15 == FUNC and value and size:
            out.append({"name": _text(names, name), "entry": value, "size": size, "source": source})
    return out


class _Cursor:
    """Numbers of an unwind section."""

    def __init__(self, data: bytes, at: int, base: int):
        self.data, self.at, self.base = data, at, base

    def take(self, form: str) -> int:
        value = struct.unpack_from("<" + form, self.data, self.at)[0]
        self.at += struct.calcsize("<" + form)
        return value

    def leb(self, signed: bool = False) -> int:
        value = shift = 0
        while True:
            b = self.take("B")
            value |= (b & 127) << shift
            shift += 7
            if not b & 128:
                return value - (1 << shift) if signed and b & 64 else value
            if shift > 70:
                raise struct.error("number too long")

    def pointer(self, encoding: int, relative: bool = True) -> int:
        if encoding & 0x80 or encoding == 0xFF:
            raise struct.error("no direct pointer")
        here = self.base + self.at
        forms = {0: "Q", 2: "H", 3: "I", 4: "Q", 10: "h", 11: "i", 12: "q"}
        low = encoding & 15
        value = self.leb(low == 9) if low in (1, 9) else self.take(forms[low]) if low in forms else None
        if value is None or (relative and encoding & 0x70 not in (0, 0x10)):
            raise struct.error("unknown encoding")
        return (value + (here if relative and encoding & 0x70 == 0x10 else 0)) & ((1 << 64) - 1)


def _pointer_encoding(data: bytes, at: int, base: int) -> int:
    """Encoding of code pointers that a common record names."""
    c = _Cursor(data, at, base)
    if c.take("I") == 0xFFFFFFFF:
        c.take("Q")
        c.take("I")
    if c.take("I") != 0:
        raise struct.error("not a common record")
    version = c.take("B")
    end = data.index(b"\0", c.at)
    letters, c.at = data[c.at : end].decode("latin-1"), end + 1
    if version == 4:
        c.take("H")
    c.leb(), c.leb(True)
    c.take("B") if version == 1 else c.leb()
    encoding = 0
    if letters[:1] == "z":
        c.leb()
        for letter in letters[1:]:
            if letter == "R":
                encoding = c.take("B")
            elif letter == "L":
                c.take("B")
            elif letter == "P":
                c.pointer(c.take("B"), relative=False)
            elif letter not in "SB":
                break
    return encoding


def _unwind_functions(data: bytes, base: int) -> list[dict]:
    """Start and length of every frame record; unreadable ones are skipped, a broken chain ends the walk."""
    out, at = [], 0
    while at + 4 <= len(data):
        try:
            c = _Cursor(data, at, base)
            length = c.take("I")
            wide = length == 0xFFFFFFFF
            if wide:
                length = c.take("Q")
            end, here = c.at + length, c.at
            if length == 0 or end > len(data):
                break
            link = c.take("I")
        except struct.error:
            break
        if link:
            try:
                encoding = _pointer_encoding(data, here - link, base) if 0 <= here - link else 0xFF
                entry, size = c.pointer(encoding), c.pointer(encoding & 15, relative=False)
                if size > 0:
                    out.append({"name": None, "entry": entry, "size": size, "source": "eh_frame"})
            except (struct.error, ValueError):
                pass
        at = end
    return out


def parse(data: bytes) -> Elf:
    """Segments and functions of a file. Functions come from the symbol tables or, if those have none, from unwind
    records; of several at one entry a named one stays, of equals the first found; sorted by entry, unsigned."""
    try:
        if data[:4] != b"\x7fELF" or data[4] != 2 or data[5] != 1:
            raise BadElf("not a little-endian 64-bit ELF file")
        machine = struct.unpack_from("<H", data, 18)[0]
        phoff, shoff = struct.unpack_from("<QQ", data, 32)
        phsize, phnum, shsize, shnum, names_at = struct.unpack_from("<5H", data, 54)
    except (struct.error, IndexError) as e:
        raise BadElf("the header is cut off") from e
    if machine != MACHINE_X86_64:
        raise BadElf(f"machine {machine} isn't x86-64")
    headers = _table(data, phoff, phsize, phnum, "<IIQQQQQQ", "program headers")
    elf = Elf(_load_segments(data, headers))
    sections = _table(data, shoff, shsize, shnum, "<IIQQQQIIQQ", "section headers")
    body = lambda s: data[s[4] : s[4] + s[5]] if s[1] != 8 else b""
    found: list[dict] = []
    dynamic = False
    for kind, source in ((SYMTAB, "symtab"), (DYNSYM, "dynsym")):
        for s in sections:
            if s[1] == kind:
                names = body(sections[s[6]]) if s[6] < len(sections) else b""
                found += _symbols(data, s[4], min(s[5], max(0, len(data) - s[4])) // 24, names, source)
                dynamic |= kind == DYNSYM
    if not dynamic and (by_segment := _dynamic_symbols(data, headers)):
        found += _symbols(data, *by_segment, "dynsym")
    if not found and names_at < len(sections):
        names = body(sections[names_at])
        for s in sections:
            if _text(names, s[0]) == ".eh_frame" and s[4] + s[5] <= len(data):
                found = _unwind_functions(body(s), s[3])
                break
    kept: dict[int, dict] = {}
    for f in sorted(found, key=lambda f: (f["entry"], f["name"] is None)):
        kept.setdefault(f["entry"], f)
    elf.functions = [f | {"entry": C.signed(f["entry"]), "size": C.signed(f["size"])} for f in kept.values()]
    return elf


ROWS = f"kind string, {FUNCTIONS}, {SEGMENTS.removeprefix('binary string, ')}, error string"
_PART = 4096


def parse_files(files: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of all files (``path, content``), each parsed once: ``kind`` (function, segment or error), ``binary`` and the fields of
    that kind; see ``split``."""
    from traceloom.functions import arrow

    target = arrow.schema(ROWS)

    def parsed(name: str, content: bytes) -> list[dict]:
        try:
            if len(content) > C.MAX_FILE:
                raise BadElf("the file is over the size limit")
            elf = parse(content)
        except BadElf as e:
            if strict:
                raise BadElf(f"{name}: {e}") from e
            return [{"kind": "error", "error": str(e)}]
        return [{"kind": "segment", "segment": k} | s for k, s in enumerate(elf.segments)] + [{"kind": "function"} | f for f in elf.functions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                name = path.as_py().rsplit("/", 1)[-1]
                rows = parsed(name, content.as_py())
                for i in range(0, len(rows), _PART):
                    yield pa.RecordBatch.from_pylist([r | {"binary": name} for r in rows[i : i + _PART]], target)

    return files.select("path", "content").mapInArrow(run, ROWS)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions, segments, errors) of what ``parse_files`` gives."""
    pick = lambda kind, ddl: rows.where(F.col("kind") == kind).select(*(f.split()[0] for f in ddl.split(", ")))
    return pick("function", FUNCTIONS), pick("segment", SEGMENTS), pick("error", "binary string, error string")


def read(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions, segments, errors) of the files at ``path``. ``binary`` is the file's name.

    A segment's ``bytes`` are its window of the file; up to ``mem_size`` it is zero. With ``strict`` a bad file stops with an
    error; otherwise it only has a row ``binary, error`` in errors. Files over 512 MiB are bad. Every file is read and
    parsed once, when this is called; the result is stored.
    """
    return split(materialize(parse_files(spark.read.format("binaryFile").load(path), strict), "elf"))


# ---- relational forms ------------------------------------------------------------------------------------------------


def dedup_functions(functions: DataFrame) -> DataFrame:
    """One function per (binary, entry): a named one first, then symtab before dynsym before eh_frame, then the smaller name."""
    place = F.array_position(F.array(*map(F.lit, C.SOURCES)), F.col("source"))
    w = Window.partitionBy("binary", "entry").orderBy(F.col("name").isNull(), F.when(place == 0, 99).otherwise(place), "name", F.col("size").desc())
    return functions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def holds(vaddr: Column, size: Column, entry: Column, length: int = 1) -> Column:
    """Whether a segment holds ``length`` bytes from ``entry`` on. Compared unsigned and by the distance, so nothing wraps."""
    after = unsigned_order(entry) >= unsigned_order(vaddr)
    # the distance of two addresses in order, as an unsigned number; beyond 2**63 it is more than any segment's size
    high = F.shiftrightunsigned(entry, 1) - F.shiftrightunsigned(vaddr, 1)
    near = after & (high < F.lit(C.MAX_SEGMENT))
    distance = F.when(near, high * 2 + entry.bitwiseAND(F.lit(1)) - vaddr.bitwiseAND(F.lit(1)))
    return F.coalesce(near & (distance + length <= size), F.lit(False))


def indexable(functions: DataFrame, segments: DataFrame) -> DataFrame:
    """Functions of a positive size whose first byte lies in a segment of their file."""
    s = segments.select(F.col("binary").alias("_b"), F.col("vaddr").alias("_v"), F.col("mem_size").alias("_m"))
    inside = (F.col("binary") == F.col("_b")) & holds(F.col("_v"), F.col("_m"), F.col("entry"))
    return functions.where(F.col("size") != 0).join(s, inside, "left_semi")


def in_segments(accesses: DataFrame, segments: DataFrame, length: int = 1) -> DataFrame:
    """``accesses`` (``binary, addr``, ...) with ``in_segment`` and ``segment``: the first segment of the access's own file that
    holds ``length`` bytes from the address on, null for none. Accesses are kept as they are, repeated rows too."""
    s = segments.select(F.col("binary").alias("_b"), F.col("vaddr").alias("_v"), F.col("mem_size").alias("_m"), F.col("segment").alias("_s"))
    asked = accesses.select("binary", "addr").distinct()
    inside = (F.col("binary") == F.col("_b")) & holds(F.col("_v"), F.col("_m"), F.col("addr"), length)
    first = asked.join(s, inside).groupBy("binary", "addr").agg(F.min("_s").alias("segment"))
    return accesses.join(first, ["binary", "addr"], "left").withColumn("in_segment", F.col("segment").isNotNull())


def whole_bytes(segments: DataFrame) -> DataFrame:
    """``segments`` with ``bytes`` as they lie in memory: the file's window and zeros up to ``mem_size``."""
    return segments.withColumn("bytes", F.rpad("bytes", F.col("mem_size").cast("int"), F.lit(b"\0")))


def mapped_pages(spans: DataFrame) -> DataFrame:
    """``binary, first, n_pages``: the pages that spans of addresses (``binary, vaddr, mem_size``) need, as longest runs of pages.

    A span covers every page that it touches; overlapping and adjoining ones share a run, so no page counts twice. Ends are
    rounded without wrapping at the top of the address space; empty spans need no page. Addresses are unsigned. Spans of
    one binary meet in one task.
    """
    page, top = C.PAGE, (1 << 52) - 1  # numbers of pages are small enough for signed arithmetic
    number = lambda x: F.shiftrightunsigned(x, 12)
    held = spans.where("mem_size > 0").select(
        "binary", number(F.col("vaddr")).alias("_a"),
        # the last page by the offset inside the first one, so that nothing can wrap
        F.least(F.lit(top), number(F.col("vaddr")) + F.floor((F.col("vaddr").bitwiseAND(F.lit(page - 1)) + F.col("mem_size") - 1) / page)).alias("_z"),
    )
    w = Window.partitionBy("binary").orderBy("_a", "_z")
    reached = F.max("_z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = held.withColumn("_new", F.coalesce((F.col("_a") > reached + 1).cast("int"), F.lit(0))).withColumn("_g", F.sum("_new").over(w))
    made = runs.groupBy("binary", "_g").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"))
    return made.select("binary", F.shiftleft("_a", 12).alias("first"), (F.col("_z") - F.col("_a") + 1).alias("n_pages"))


def name_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds ``sym`` to ``calls`` (``binary, target``): the named function at the target; null for others, so imported
    functions, which have no body here, stay anonymous."""
    names = functions.where("name IS NOT NULL").groupBy("binary", F.col("entry").alias("target")).agg(F.min("name").alias("sym"))
    return calls.join(names, ["binary", "target"], "left")
