"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def apply(sql_lambda: str, value: Column) -> Column:
    """Apply a one-argument SQL lambda, given as text: one parse instead of a call per node."""
    return F.call_function("transform", F.array(value), F.expr(sql_lambda))[0]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` mentions it.

    Repeating a nested expression by hand multiplies its size and its cost, most of all inside
    lambdas, where Spark does not share common parts.
    """
    return F.transform(F.array(value), body)[0]
