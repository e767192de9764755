"""Pandas UDFs that are made when they are first used, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def lazy_udf(ddl: str) -> Callable:
    def decorate(function: Callable) -> Callable[..., Column]:
        @wraps(function)
        def call(*columns) -> Column:
            return F.pandas_udf(function, ddl)(*columns)

        call.python = function
        return call

    return decorate
