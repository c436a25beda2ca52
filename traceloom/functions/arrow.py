"""Arrow schemas from Spark's DDL."""

from __future__ import annotations

import pyarrow as pa

_TYPES = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(),
    "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()),
}


def schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in ddl.split(", ")])
