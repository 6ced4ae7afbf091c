"""Address components learned per country, and records normalised again without them (LRN-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def component(c: Column) -> Column:
    """A component of an address in lower case, its outer blanks and stops removed."""
    return F.lower(F.regexp_replace(c, "^[\\s.]+|[\\s.]+$", ""))


def learned_components(reference: DataFrame, pool: DataFrame, least: float = 0.005, country: str = "country", address: str = "business_address") -> DataFrame:
    """(country, part): last components that are frequent in the reference, or frequent in the pool and ten times rarer in the reference.

    Components with digits or without characters are never learned.
    """

    def shares(df: DataFrame, name: str) -> DataFrame:
        part = component(F.element_at(F.split(F.coalesce(F.col(address), F.lit("")), ","), -1))
        n = df.groupBy(country).agg(F.count("*").alias("all"))  # one row a country
        by = df.groupBy(country, part.alias("part")).agg(F.count("*").alias("n"))
        return by.join(F.broadcast(n), country).select(country, "part", (F.col("n") / F.col("all")).alias(name))

    x = shares(reference, "r").join(shares(pool, "p"), [country, "part"], "full").na.fill(0.0, ["r", "p"])
    x = x.where((F.col("r") >= least) | ((F.col("p") >= least) & (F.col("r") < F.col("p") / 10)))
    return x.where("part <> '' and not part rlike '[0-9]'").select(country, "part")


def without_components(df: DataFrame, learned: DataFrame, country: str = "country", address: str = "business_address") -> DataFrame:
    """``df`` with the learned components taken out of its addresses; the learned table has a row a country after grouping."""
    lists = learned.groupBy(country).agg(F.collect_set("part").alias("__gone"))
    x = df.join(F.broadcast(lists), country, "left")
    parts = F.filter(F.split(F.col(address), ","), lambda p: ~F.array_contains(F.coalesce("__gone", F.array().cast("array<string>")), component(p)))
    return x.withColumn(address, F.array_join(parts, ",")).select(*df.columns)
