"""C-style number text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def g9(value: Column) -> Column:
    """`%.9g` of a float. Java's formatter pads with zeros, so this one runs over Arrow batches."""

    @F.pandas_udf("string")
    def shown(v: pd.Series) -> pd.Series:
        return pd.Series([None if x != x and x is not None else "%.9g" % x for x in v.astype("float64")], dtype=object)

    return shown(value)
