"""The first n rows of each group, as rows.

``top_n`` cuts one row's array; this is the form for items that are rows already, such as exploded ones.  A filter
on ``row_number`` lets Spark prune in each map task (``WindowGroupLimit``): a group sends at most n rows a task, so a
group that holds a third of all rows is no hot task.  Spark does so up to ``spark.sql.optimizer.windowGroupLimitThreshold``
(1,000) rows; beyond that the whole groups are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """At most ``n`` rows of each group of ``keys``, first in ``order``; ``rank`` names a column for their places (from 1).

    NULL keys are a group. Of rows that ``order`` doesn't tell apart any may stay: end it with a unique column.
    """
    if n < 1:
        raise ValueError(f"n must be 1 or more: {n}")
    place = rank or "_place"
    numbered = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = numbered.where(F.col(place) <= n)
    return kept if rank else kept.drop(place)
