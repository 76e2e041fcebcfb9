"""Evaluate an expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` bound to a lambda variable.

    Array functions evaluate whatever their lambda mentions once per element. A value that
    is bound here first is computed once per row instead.
    """
    return F.transform(F.array(value), use).getItem(0)
