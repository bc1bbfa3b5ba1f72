"""Array -> rows without a duplicated array computation.

For a plain ``explode``/``posexplode`` Catalyst infers the filter
``size(arr) > 0 AND arr IS NOT NULL`` and pushes it towards the scan; when
``arr`` is an expensive expression (higher-order functions over a text, a
Python UDF) that filter evaluates it again, below any repartition.  The
``_outer`` generators get no inferred filter; the rows they add for empty or
null arrays (null position) are dropped afterwards, so the result is exactly
the plain generator's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def posexplode_rows(df: DataFrame, keep: Sequence[str | Column], arr: Column,
                    pos: str = "pos", val: str = "col") -> DataFrame:
    return (df.select(*keep, F.posexplode_outer(arr).alias(pos, val))
            .where(F.col(pos).isNotNull()))


def explode_rows(df: DataFrame, keep: Sequence[str | Column], arr: Column,
                 val: str = "col") -> DataFrame:
    return posexplode_rows(df, keep, arr, "_pos", val).drop("_pos")
