"""Arrow UDFs that are made when called, so modules with them can be imported where there is no session."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def vectorised(returns: str):
    def wrap(kernel):
        @functools.wraps(kernel)
        def column(*columns):
            return F.pandas_udf(kernel, returns)(*columns)

        return column

    return wrap
