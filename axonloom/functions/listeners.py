"""User aggregates over ordered events as Arrow UDFs, and pair functions of arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_aggregate(step: Callable[[np.ndarray, np.ndarray], float]):
    """A grouped aggregate (time, value) -> double whose ``step`` sees one group's events in time order. Only for
    groups of bounded size; what sums can express should be sums."""

    @F.pandas_udf(T.DoubleType())
    def run(t: pd.Series, x: pd.Series) -> float:
        order = np.argsort(t.to_numpy(), kind="stable")
        return float(step(t.to_numpy()[order], x.to_numpy()[order]))

    return run


def array_correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation of two equally long arrays of a row; 0 without spread."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    real = lambda x: F.transform(x, lambda v: v.cast("double"))
    around = lambda x: F.transform(x, lambda v: v - total(x) / F.size(x))
    x, y = around(real(a)), around(real(b))
    power = F.sqrt(total(F.transform(x, lambda v: v * v)) * total(F.transform(y, lambda v: v * v)))
    return F.when(power > 0, total(F.zip_with(x, y, lambda v, w: v * w)) / power).otherwise(0.0)
