"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned: expressions are trees, and
    one that mentions another twice holds it twice."""
    return F.transform(F.array(value), use)[0]
