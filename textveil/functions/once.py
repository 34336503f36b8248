"""Values that an expression uses several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once. Within functions over arrays, Spark computes it wherever it stands; nested
    uses multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
