"""Joins that a few very frequent keys do not pile up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

#: A key is frequent if it holds more than a HOTth part of a table's rows, so fewer than HOT keys are.
HOT = 1000
#: Rows of a table up to which one task can hold all of it.
LITTLE = 20_000


def frequent(table: DataFrame, on: list[str], scratch: Scratch) -> DataFrame | None:
    """The frequent keys of a written table (fewer than HOT rows, written); None if the table is small or has none."""
    total = table.count()
    if total <= LITTLE:
        return None
    keys = scratch.cut(table.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > total // HOT).select(*on).dropna(), "frequent")
    return None if keys.isEmpty() else keys


def join_unique(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key; ``hot`` (fewer than HOT keys) is answered by a broadcast.

    Rows of ``left`` with a frequent key stay where they are; the others shuffle.
    ``how`` is inner or left.
    """
    if hot is None:
        return left.join(right, on, how)
    few = F.broadcast(hot)
    answers = right.join(few, on, "left_semi")
    stay = left.join(few, on, "left_semi").join(F.broadcast(answers), on, how)
    return stay.unionByName(left.join(few, on, "left_anti").join(right.join(few, on, "left_anti"), on, how))
