"""Fingerprints that grow with a stream of traces.

The slot minima of a function over more and more traces are minima again, so the state is 128 numbers per function
whatever the number of its traces. Shingles stay inside a trace, which arrives whole in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom import constants as C
from traceloom.functions.hashing import unsigned_order
from traceloom.operators.fingerprint import sign, trace_shingles


def running_slots(traces: DataFrame, key: str = "func_id") -> DataFrame:
    """``key, slot, value, complexity, capped`` of a stream (or table) of traces, for update or complete mode.

    Traces without shingles change no slot (a key that has only such has no row); traces delivered twice change nothing,
    so no deduplication state is needed.
    """
    per_trace = trace_shingles(traces, key).where(F.size("shingles") > 0)
    signed = sign(per_trace, key, ("complexity", "capped"))
    slots = signed.select(key, "complexity", "capped", F.posexplode("sig").alias("slot", "value"))
    low = F.min(unsigned_order(F.col("value"))).alias("_v")
    grown = slots.groupBy(key, "slot").agg(low, F.max("complexity").alias("complexity"), F.bool_or("capped").alias("capped"))
    return grown.select(key, "slot", unsigned_order(F.col("_v")).alias("value"), "complexity", "capped")


def assemble(slots: DataFrame, key: str = "func_id") -> DataFrame:
    """``key, sig, complexity, capped`` from the latest slot rows; keys with fewer than 128 slots are left out."""
    by_slot = F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda x: x["value"])
    out = slots.groupBy(key).agg(by_slot.alias("sig"), F.max("complexity").alias("complexity"), F.bool_or("capped").alias("capped"))
    return out.where(F.size("sig") == C.SLOTS)
