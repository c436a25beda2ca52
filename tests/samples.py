"""Small rows for tests."""

from traceloom.constants import signed
from traceloom.functions.effects import EFFECT
from traceloom.operators.corpus import FUNCS

KEYS = ("seq", "ic", "kind", "region", "region_k", "off", "val", "val_k", "sym", "nr")
TRACES = f"trace_id bigint, func_id bigint, effects array<{EFFECT}>, capped boolean"


def effect(kind, **over):
    return {k: None for k in KEYS} | {"kind": kind} | over


def write(region, off, val, val_k=None, k=None):
    return effect("write", region=region, region_k=k, off=off, val=val, val_k=val_k)


def numbered(effects):
    return [e | {"seq": i, "ic": 3 * i} for i, e in enumerate(effects)]


def traces(spark, rows):
    """rows: (trace_id, func_id, effects or None, capped)"""
    data = [(t, f, None if e is None else [tuple(x[k] for k in KEYS) for x in e], c) for t, f, e, c in rows]
    return spark.createDataFrame(data, TRACES)


def sig(seed):
    return [signed(i * seed) for i in range(128)]


def func(id, seed, name="f", complexity=10, shingles=20, binary="b", entry=0, slots=None):
    return (id, binary, name, entry, "symtab", complexity, shingles, False, sig(seed) if slots is None else slots)


def funcs(spark, rows):
    return spark.createDataFrame(rows, FUNCS)


BASE = numbered(
    [effect("new_region", region="arg", region_k=0)]
    + [write("arg", i * 8, "input", i % 3, 0) for i in range(8)]
    + [effect("call", sym="memcpy"), effect("branch"), effect("ret", val="input", val_k=0)]
)
EDIT = [e if i != 4 else e | {"val": "small_const", "val_k": 7} for i, e in enumerate(BASE)]
UNRELATED = numbered(
    [
        effect("call", sym="malloc"), effect("new_region", region="heapish"), effect("call", sym="free"), effect("branch"), effect("branch"),
        effect("syscall", nr=1), effect("ret", val="big_const"),
    ]
)
