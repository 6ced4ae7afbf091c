"""Scans and sinks (SRC, SNK): tab-separated records, truth lists, Parquet, JSON, CSV, list files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SOURCE, TRUTH, require


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); a temporary one where it is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="resolvent-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def scan_tsv(spark: SparkSession, path: str, schema=SOURCE) -> DataFrame:
    """Header, tabs, no quoting, all strings; an empty field is null."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)


def scan_raw(spark: SparkSession, path: str, rows: int | None = None, schema=SOURCE) -> DataFrame:
    """The fields as they stand (nothing is read as missing, an empty field is the empty string), the first ``rows`` only."""
    x = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path).na.fill("")
    return x if rows is None else x.limit(rows)


def scan_source(spark: SparkSession, path: str) -> DataFrame:
    """A source file with checked columns: header names trimmed, carriage returns removed, empty strings kept as such."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("inferSchema", False).csv(path)
    raw = raw.toDF(*[c.strip().strip("\r") for c in raw.columns])
    require(raw, SOURCE.fieldNames())
    clean = lambda c: F.coalesce(F.regexp_replace(F.col(c), "\r", ""), F.lit("")).alias(c)
    return raw.select(*[clean(c) for c in SOURCE.fieldNames()])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("sep", "\t").option("header", True).option("quote", "").option("escapeQuotes", False).option("emptyValue", "").csv(path)


def only_ids(df: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows whose id is listed."""
    return df.join(ids.select(key), key, "left_semi")


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1_id, target_id) from rows with comma-separated lists; empty lists give no rows."""
    x = truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ",")).alias("target_id"))
    return x.select("s1_id", F.trim("target_id").alias("target_id")).where("target_id <> ''")


def scan_truth(spark: SparkSession, path: str) -> DataFrame:
    return truth_pairs(scan_tsv(spark, path, TRUTH))


def find_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path) of files under ``root`` with a name in any case, through Spark's own listing."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return x.where(F.lower(F.element_at(F.split("path", "/"), -1)) == name.lower())


def id_lists(s1: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row per reference id: its target ids sorted and comma-joined, empty for none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias(name))
    return s1.select("s1_id").distinct().join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def union_lists(a: DataFrame, b: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """Two list files as one: ids of either, in order, without repeats."""
    x = a.withColumnRenamed(name, "x").join(b.withColumnRenamed(name, "y"), "source1_entity_id", "left")
    parts = F.array_remove(F.array_union(F.split("x", ","), F.split(F.coalesce("y", F.lit("")), ",")), "")
    return x.select("source1_entity_id", F.array_join(F.array_sort(parts), ",").alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.option("header", True).csv(path)
