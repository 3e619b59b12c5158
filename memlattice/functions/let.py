"""A value that is computed once and used many times within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value bound to a lambda's variable. Written out, a fold would compute it anew in each step."""
    return F.get(F.transform(F.array(value), body), 0)
