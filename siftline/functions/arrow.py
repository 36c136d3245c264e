"""Arrow functions that are made when they are used, as their types can only be read once a session runs."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """Make a function over pandas series a function over columns."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return wrap
