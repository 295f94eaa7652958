"""Helpers to build column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), then)[0]


def steps(value: Column, *then: Callable[[Column], Column]) -> Column:
    """Feed a value through a chain of expressions, each computed once."""
    for step in then:
        value = let(value, step)
    return value
