"""Evaluate a costly array expression once and use it many times inside one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable.

    A plain reference would be inlined by the optimizer into every place of use, and evaluated again for each
    element where that place is a higher-order function.
    """
    return F.transform(F.array(value), body)[0]
