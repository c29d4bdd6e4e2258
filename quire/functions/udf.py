"""Arrow user functions over text columns, made when they are used (workers import modules without a session)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def over_text(f: Callable[[str], object], result: str = "string") -> Callable[[Column], Column]:
    """A Column function that applies ``f`` to each text that isn't null."""

    def call(c: Column) -> Column:
        def run(s: pd.Series) -> pd.Series:
            return s.map(f, na_action="ignore")

        run.__annotations__ = {"s": pd.Series, "return": pd.Series}
        return pandas_udf(run, result)(c)

    call.__doc__ = f.__doc__
    return call
