"""Windows over a record's candidates and adaptive cuts (WIN, TOP)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: str = "s1_id", score: str = "score", tie: str = "target_id", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)))


def group_context(df: DataFrame, group: str = "s1_id", score: str = "score", tie: str = "target_id", prefix: str = "") -> DataFrame:
    """Rank, best, second best (-1 if none), gap to the best, ratio, top gap, size and margin to the next."""
    o = Window.partitionBy(group).orderBy(F.desc(score), tie)
    g = Window.partitionBy(group)
    x = df.withColumn(f"{prefix}rank", F.row_number().over(o)).withColumn(f"{prefix}next", F.lead(score).over(o))
    x = x.withColumn(f"{prefix}top", F.max(score).over(g)).withColumn(f"{prefix}size", F.count("*").over(g))
    second = F.max(F.when(F.col(f"{prefix}rank") == 2, F.col(score))).over(g)
    x = x.withColumn(f"{prefix}second", F.coalesce(second, F.lit(-1.0)))
    return x.withColumns({
        f"{prefix}gap": F.col(f"{prefix}top") - F.col(score), f"{prefix}ratio": F.col(score) / (F.col(f"{prefix}top") + 1e-6),
        f"{prefix}topgap": F.col(f"{prefix}top") - F.col(f"{prefix}second"), f"{prefix}margin_next": F.coalesce(F.col(score) - F.col(f"{prefix}next"), F.lit(0.0)),
    }).drop(f"{prefix}next")


def adaptive_cut(df: DataFrame, ceiling: int = 25, steep: float = 0.85, gap: float = 0.35, few: int = 3) -> DataFrame:
    """All of up to ``few`` candidates; ``few`` of them after a clear winner; else ``ceiling``."""
    x = group_context(df)
    k = F.when((F.col("top") >= steep) & (F.col("topgap") > gap), few).otherwise(ceiling)
    return x.where((F.col("size") <= few) | (F.col("rank") <= k)).select(*df.columns, "rank")


def ratio_cut(df: DataFrame, ratio: float = 0.5, least: int = 3, most: int = 20) -> DataFrame:
    """At least ``least``, then those within ``ratio`` of the best, at most ``most``."""
    x = group_context(df)
    return x.where((F.col("rank") <= least) | ((F.col("rank") <= most) & (F.col("score") >= ratio * F.col("top")))).select(*df.columns, "rank")


def budget_cut(df: DataFrame, budgets: tuple[tuple[float, float, int], ...] = ((0.9, 0.3, 6), (0.7, 0.15, 12), (0.5, 0.0, 22)), otherwise: int = 40) -> DataFrame:
    """A budget by the best score and the gap behind it."""
    x = group_context(df)
    k = F.lit(otherwise)
    for top, gap, n in reversed(budgets):
        k = F.when((F.col("top") >= top) & (F.col("topgap") >= gap), n).otherwise(k)
    return x.where(F.col("rank") <= k).select(*df.columns, "rank")


def any_rank_cut(df: DataFrame, limits: dict[str, int], group: str = "s1_id", tie: str = "target_id") -> DataFrame:
    """Rows among the first k by any of several scores."""
    keep = F.lit(False)
    x = df
    for i, (score, k) in enumerate(limits.items()):
        x = x.withColumn(f"__r{i}", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)))
        keep = keep | (F.col(f"__r{i}") <= k)
    return x.where(keep).select(*df.columns)


def capped_by_source(df: DataFrame, each: int = 5, total: int | None = 8, group: str = "s1_id", score: str = "prob", tie: str = "target_id") -> DataFrame:
    """At most ``each`` per source (id prefix) and ``total`` in all."""
    src = F.substring(tie, 1, 2)
    x = df.withColumn("__r", F.row_number().over(Window.partitionBy(group, src).orderBy(F.desc(score), tie))).where(F.col("__r") <= each)
    if total is not None:
        x = x.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))).where(F.col("__r") <= total)
    return x.drop("__r")
