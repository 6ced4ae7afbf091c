"""Declared schemas; every input column is a string and nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])


def require(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` if it has all columns, else a ValueError that names the missing ones."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df
