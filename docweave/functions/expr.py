"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A plain derived column can be inlined by the optimizer into a lambda, where it would
    be evaluated once per array element; a lambda variable cannot.
    """
    # A fold of nothing: its start is bound and handed to ``body``. Unlike ``transform`` it does not copy the result.
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)
