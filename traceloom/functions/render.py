"""Text for terminals: escaped bytes and readable effects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceloom.functions.binding import let


def escape(s: Column) -> Column:
    """Every byte outside printable ASCII and space becomes ``\\xNN``; null stays null."""

    def spell(raw: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2)), lambda i: F.substring(raw, i, F.lit(2)))
        plain = lambda h: h.between("20", "7E")
        text = F.transform(pairs, lambda h: F.when(plain(h), F.decode(F.unhex(h), "UTF-8")).otherwise(F.concat(F.lit("\\x"), F.lower(h))))
        return F.array_join(text, "")

    odd = s.rlike("[^\\x20-\\x7e]")
    return F.when(s.isNull() | ~odd, s).otherwise(let(F.hex(F.encode(s, "UTF-8")), spell))


def hex_entry(entry: Column) -> Column:
    """Address with eight hexadecimal digits at least."""
    digits = F.lower(F.hex(entry))
    return F.concat(F.lit("0x"), F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits))


def percent(x: Column) -> Column:
    return F.format_string("%5.1f%%", x * 100)


def _region(e: Column) -> Column:
    named = F.when(e["region"] == "stack", "Stack").when(e["region"] == "global", "Global").when(e["region"] == "heapish", "Heapish")
    return F.when(e["region"] == "arg", F.format_string("Arg(%d)", e["region_k"])).otherwise(named)


def _value(e: Column) -> Column:
    out = None
    for name, label in (("input", "Input"), ("input_deriv", "InputDeriv"), ("small_const", "SmallConst")):
        text = F.format_string(f"{label}(%d)", e["val_k"])
        out = F.when(e["val"] == name, text) if out is None else out.when(e["val"] == name, text)
    return out.when(e["val"] == "zero", "Zero").when(e["val"] == "big_const", "BigConst").when(e["val"] == "unknown", "Unknown")


def effect_text(e: Column) -> Column:
    """An effect struct as one readable line."""
    quoted = F.concat(F.lit('Sym("'), F.regexp_replace(e["sym"], r'(["\\])', r"\\$1"), F.lit('")'))
    return (
        F.when(e["kind"] == "write", F.concat(F.lit("Write { region: "), _region(e), F.format_string(", off: %d, val: ", e["off"]), _value(e), F.lit(" }")))
        .when(e["kind"] == "read", F.concat(F.lit("Read { region: "), _region(e), F.format_string(", off: %d }", e["off"])))
        .when(e["kind"] == "new_region", F.concat(F.lit("NewRegion("), _region(e), F.lit(")")))
        .when(e["kind"] == "call", F.concat(F.lit("Call("), F.coalesce(quoted, F.lit("Anon")), F.lit(")")))
        .when(e["kind"] == "syscall", F.format_string("Syscall(%d)", e["nr"]))
        .when(e["kind"] == "branch", "Branch")
        .when(e["kind"] == "ret", F.concat(F.lit("Ret("), _value(e), F.lit(")")))
        .when(e["kind"] == "capped", "Capped")
    )
