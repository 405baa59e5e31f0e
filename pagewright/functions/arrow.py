"""Arrow functions that are built when first used, so that executors can import their modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, wraps

from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def arrow_udf(schema: str) -> Callable:
    def decorate(f: Callable) -> Callable[..., Column]:
        made = cache(lambda: pandas_udf(f, schema))

        @wraps(f)
        def call(*columns: Column) -> Column:
            return made()(*columns)

        return call

    return decorate
