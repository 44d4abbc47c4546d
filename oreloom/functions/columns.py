"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once.

    The optimizer may merge projections and so put a column's expression wherever the
    column stands, even inside a lambda that runs once per array element.  A lambda
    variable is a value and can't be replaced.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def once(value: Column) -> Column:
    """``value``, in a form that the optimizer computes where it stands and nowhere else.

    It copies a projected expression into filters above it, however much it costs, but not one
    that isn't deterministic; what makes this one so decides nothing.
    """
    return F.when(F.spark_partition_id() >= 0, value)
