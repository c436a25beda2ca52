"""Effects: schema, tokens, complexity, value and address classes, rendering."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.functions import hashing as H
from traceloom.functions.binding import let

FIELDS = "seq int, ic bigint, kind string, region string, region_k int, off int, val string, val_k bigint, sym string, nr bigint"
EFFECT = f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>"
TRACES = (
    "trace_id bigint, func_id bigint, binary string, seed_ix int, "
    f"effects array<{EFFECT}>, instret bigint, capped boolean, traced_at timestamp_ntz, loaded_at timestamp_ntz"
)


# ---- columns ---------------------------------------------------------------------------------------------------------


def _lookup(key: Column, table: dict[str, int]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v).cast("long")) for k, v in table.items()))[key]


def _tag(x: int) -> Column:
    return F.array(F.lit(x).cast("long"))


def _region_bytes(e: Column) -> Column:
    tag = F.array(_lookup(e["region"], C.REGION_TAGS))
    return F.when(e["region"] == "arg", F.concat(tag, H.le_bytes(e["region_k"].cast("long")))).otherwise(tag)


def _value_bytes(e: Column) -> Column:
    tag = F.array(_lookup(e["val"], C.VALUE_TAGS))
    kept = e["val"].isin("input", "input_deriv", "small_const")
    return F.when(kept, F.concat(tag, H.le_bytes(e["val_k"]))).otherwise(tag)


def token_bytes(e: Column) -> Column:
    """The bytes that an effect is hashed from, in the order of its fields."""
    t, off = C.EFFECT_TAGS, H.le_bytes(e["off"].cast("long"))
    called = F.when(e["sym"].isNull(), _tag(C.CALL_ANONYMOUS)).otherwise(F.concat(_tag(C.CALL_NAMED), H.utf8_bytes(e["sym"])))
    return (
        F.when(e["kind"] == "write", F.concat(_tag(t["write"]), _region_bytes(e), off, _value_bytes(e)))
        .when(e["kind"] == "read", F.concat(_tag(t["read"]), _region_bytes(e), off))
        .when(e["kind"] == "new_region", F.concat(_tag(t["new_region"]), _region_bytes(e)))
        .when(e["kind"] == "call", F.concat(_tag(t["call"]), called))
        # a syscall number is 32 bits wide
        .when(e["kind"] == "syscall", F.concat(_tag(t["syscall"]), H.le_bytes(e["nr"].bitwiseAND(F.lit(0xFFFFFFFF)))))
        .when(e["kind"] == "branch", _tag(t["branch"]))
        .when(e["kind"] == "ret", F.concat(_tag(t["ret"]), _value_bytes(e)))
        .when(e["kind"] == "capped", _tag(t["capped"]))
    )


def token(e: Column) -> Column:
    """Token of an effect struct as BIGINT. Null if the kind is unknown or a field it needs is null."""
    return H.fnv1a(token_bytes(e))


def weight(e: Column) -> Column:
    """What an effect adds to its trace's complexity."""
    plain = F.coalesce(_lookup(e["kind"], C.COMPLEXITY), F.lit(0).cast("long"))
    told = (e["kind"] == "ret") & e["val"].isin(*C.COMPLEXITY_RET)
    return F.when(told, F.lit(1).cast("long")).otherwise(plain)


def complexity(effects: Column) -> Column:
    """Complexity of an array of effects; 0 for a null or empty one."""
    summed = F.aggregate(effects, F.lit(0).cast("long"), lambda a, e: a + weight(e))
    return F.coalesce(summed, F.lit(0).cast("long"))


def in_order(effects: Column) -> Column:
    """Effects sorted by ``seq``, each ``seq`` once (of several deliveries the one that sorts first)."""

    def once(s: Column) -> Column:
        return F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["seq"] != e["seq"]))

    return let(F.array_sort(F.filter(effects, lambda e: e["seq"].isNotNull())), once)


def arg_base(k: int) -> int:
    return C.ARG_BASE + k * C.ARG_STRIDE


def mask_to_size(value: Column, size: Column) -> Column:
    """Keep the bytes that were accessed; sizes other than 1, 2 and 4 keep all."""
    out = value
    for n in (4, 2, 1):
        out = F.when(size == n, value.bitwiseAND(F.lit((1 << 8 * n) - 1))).otherwise(out)
    return out


def classify_value(value: Column) -> Column:
    """``struct<val, val_k>`` of a 64-bit value: zero, a seeded argument, near one, a small constant, or just big."""

    def as_(name: str, k: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("val"), (F.lit(None) if k is None else k).cast("long").alias("val_k"))

    out = F.when(value == 0, as_("zero"))
    for k in range(C.ARGS):
        base = arg_base(k)
        out = out.when(value == base, as_("input", F.lit(k)))
        out = out.when((value > base) & (value < base + C.ARG_SIZE), as_("input_deriv", F.lit(k)))
    out = out.when(value.between(-C.SMALL_CONST, C.SMALL_CONST), as_("small_const", value))
    return F.when(value.isNotNull(), out.otherwise(as_("big_const")))


def classify_address(addr: Column, in_segment: Column) -> Column:
    """``struct<region, region_k, off>`` of an address. ``in_segment`` tells whether the binary's own segments hold it."""

    def as_(name: str, off: Column, k: int | None = None) -> Column:
        return F.struct(F.lit(name).alias("region"), F.lit(k).cast("int").alias("region_k"), off.cast("long").alias("off"))

    out = None
    for k in range(C.ARGS):
        base = arg_base(k)
        test = (addr >= base) & (addr < base + C.ARG_SIZE)
        hit = as_("arg", addr - base, k)
        out = F.when(test, hit) if out is None else out.when(test, hit)
    stack = (addr >= C.STACK_BASE) & (addr < C.STACK_BASE + C.STACK_SIZE)
    # subtract only where it can't overflow
    out = out.when(stack, as_("stack", F.when(stack, addr - C.STACK_START)))
    out = out.when(in_segment, as_("global", F.lit(0)))
    return F.when(addr.isNotNull(), out.otherwise(as_("heapish", addr.bitwiseAND(F.lit(C.PAGE - 1)))))


def bucket_offset(off: Column) -> Column:
    """Offsets in steps of eight, truncated toward zero, within the limits."""
    step = (off.cast("long") - off.cast("long") % C.OFFSET_STEP).cast("long")
    return F.greatest(F.lit(-C.OFFSET_LIMIT), F.least(F.lit(C.OFFSET_LIMIT), step)).cast("int")


def instruction_kind(mnemonic: Column) -> Column:
    """call, ret, syscall, branch or plain. An unconditional jump is plain; null (undecodable) too."""
    m = F.coalesce(mnemonic, F.lit(""))
    return (
        F.when(m.startswith("call"), "call").when(m.startswith("ret"), "ret").when(m.isin("syscall", "sysenter", "int"), "syscall")
        .when(m.startswith("j") & (m != "jmp"), "branch").otherwise("plain")
    )


def _byte_at(code: Column, i: int) -> Column:
    """Byte ``i`` (from 0) of a binary as BIGINT; null past its end."""
    return F.when(F.length(code) > i, F.conv(F.hex(F.substring(code, i + 1, 1)), 16, 10).cast("long"))


def _relative(code: Column, first: int, n: int) -> Column:
    """Signed little-endian number of ``n`` bytes."""
    raw = None
    for k in range(n):
        part = F.shiftleft(_byte_at(code, first + k), 8 * k)
        raw = part if raw is None else raw.bitwiseOR(part)
    return F.when(raw >= 1 << (8 * n - 1), raw - (1 << 8 * n)).otherwise(raw)


def call_target(addr: Column, length: Column, code: Column) -> Column:
    """Where a direct call (e8, rel32) goes, modulo 2**64; null for other calls."""
    goes = H.wrap_add(H.wrap_add(addr, length.cast("long")), _relative(code, 1, 4))
    return F.when(_byte_at(code, 0) == 0xE8, goes)


def branch_target(addr: Column, length: Column, code: Column) -> Column:
    """Where a taken conditional jump (70 to 7f rel8, 0f 80 to 8f rel32) goes, modulo 2**64; null for other encodings."""
    after = H.wrap_add(addr, length.cast("long"))
    near = F.when(_byte_at(code, 0).between(0x70, 0x7F), H.wrap_add(after, _relative(code, 1, 1)))
    far = (_byte_at(code, 0) == 0x0F) & _byte_at(code, 1).between(0x80, 0x8F)
    return F.coalesce(near, F.when(far, H.wrap_add(after, _relative(code, 2, 4))))


def fill_word(base: Column, word: Column, seed: int) -> Column:
    """Deterministic content of the 8-byte word number ``word`` of a page at ``base``."""
    seeded = H.wrap_add(H.wrap_add(base, F.shiftleft(word.cast("long"), 3)), F.lit(C.signed(seed * C.GOLDEN)))

    def shifted(x: Column, n: int) -> Column:
        return x.bitwiseXOR(F.shiftrightunsigned(x, n))

    # every stage is bound once; inlined, each would be repeated in all places of the next
    def second(x: Column) -> Column:
        return let(shifted(x, 27), lambda y: let(H.wrap_mul(y, C.FILL_MUL_2), lambda z: shifted(z, 31)))

    return let(seeded, lambda x: let(shifted(x, 30), lambda y: let(H.wrap_mul(y, C.FILL_MUL_1), second)))


def call_result(counter: Column) -> Column:
    """What a skipped call leaves in the result register: a constant mixed with the run's counter."""
    return H.wrap_mul(counter.cast("long"), C.GOLDEN).bitwiseXOR(F.lit(C.CALL_RESULT))


def syscall_result(counter: Column) -> Column:
    return counter.cast("long").bitwiseXOR(F.lit(C.SYSCALL_RESULT))


# ---- numpy -----------------------------------------------------------------------------------------------------------


class Coded:
    """A text column as numbers into its distinct values; null is -1. What depends on the text is looked up once per value."""

    def __init__(self, column: pa.Array):
        coded = pc.dictionary_encode(column)
        self.codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        self.names: list[str | None] = [*coded.dictionary.to_pylist(), None]  # the last place answers for -1

    def take(self, at: np.ndarray) -> Coded:
        out = object.__new__(Coded)
        out.codes, out.names = self.codes[at], self.names
        return out

    def look(self, values: dict[str | None, int] | Callable[[str | None], int], kind: type = np.uint64) -> np.ndarray:
        of = values if callable(values) else lambda x: values.get(x, 0)
        return np.array([of(x) for x in self.names], kind)[self.codes]


def np_tokens(kind: Coded, region: Coded, region_k: np.ndarray, off: np.ndarray, val: Coded, val_k: np.ndarray, sym: Coded, nr: np.ndarray) -> np.ndarray:
    """Tokens of flat effect arrays (int64 arrays with 0 for null), as uint64; 0 for unknown kinds."""
    tags = kind.look(C.EFFECT_TAGS)
    out = np.zeros(len(tags), np.uint64)
    region_tag, in_arg = region.look(C.REGION_TAGS), region.look({"arg": 1}, bool)
    value_tag, with_k = val.look(C.VALUE_TAGS), val.look(dict.fromkeys(("input", "input_deriv", "small_const"), 1), bool)

    def tagged(h: np.ndarray, at: np.ndarray, tag: np.ndarray, more: np.ndarray, word: np.ndarray) -> np.ndarray:
        h = H.np_byte(h, tag[at])
        wide = more[at]
        h[wide] = H.np_word(h[wide], word[at[wide]])
        return h

    for name, tag in C.EFFECT_TAGS.items():
        at = np.flatnonzero(tags == tag)
        if not len(at):
            continue
        h = H.np_byte(H.np_start(len(at)), tag)
        if name in ("write", "read", "new_region"):
            h = tagged(h, at, region_tag, in_arg, region_k)
        if name in ("write", "read"):
            h = H.np_word(h, off[at])
        if name in ("write", "ret"):
            h = tagged(h, at, value_tag, with_k, val_k)
        if name == "syscall":
            h = H.np_word(h, nr[at] & 0xFFFFFFFF)
        if name == "call":
            spelled = lambda s: bytes([tag, C.CALL_ANONYMOUS]) if s is None else bytes([tag, C.CALL_NAMED]) + s.encode()  # noqa: B023, E731
            h = sym.look(lambda s: H.py_fnv(spelled(s)))[at]
        out[at] = h
    return out


def np_complexity(kind: Coded, val: Coded) -> np.ndarray:
    """What each effect adds to its trace's complexity."""
    told = kind.look({"ret": 1}, bool) & val.look(dict.fromkeys(C.COMPLEXITY_RET, 1), bool)
    return np.where(told, 1, kind.look(C.COMPLEXITY, np.int64))
