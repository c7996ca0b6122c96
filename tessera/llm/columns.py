"""Small helpers for expressions over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, as a lambda variable; a plain column would be computed at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)
