"""A training-corpus pipeline of five stages, each one operator of ``resolvent.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``, with the values they had, whatever names an
operator gives to its own columns.  ``run`` writes each stage's result as
Parquet in the shared folder and gives it to the next.  An empty table gives an
empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resolvent.llm._scratch import Scratch
from resolvent.llm.importance import good_labels, resample
from resolvent.llm.line_dedup import dedup_lines
from resolvent.llm.mixing import mix_sources, quality_weight
from resolvent.llm.ngram_join import ngram_components
from resolvent.llm.packing import pack


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with the columns that an operator would replace put aside, and the columns as they were."""
    to = {c: f"__in_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(to), [F.col(f"`{to.get(c, c)}`").alias(c) for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps.

    A null or empty text weighs 0 and is judged like any other; a null id has no
    label.  Repeated rows are judged alike, ties with the last kept key stay.
    """
    docs, columns = _aside(docs, ("log_weight", "gumbel_key", "kept"))
    return resample(docs, good_labels(spark, sf_dir)).where("kept").select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that loses all its lines goes.

    A null or empty text stays as it is, and so does a null id; repeated rows
    get the same result.  ``n_chars``, if there, follows the text.
    """
    docs, columns = _aside(docs, ("dropped_lines",))
    out = dedup_lines(docs, shortest=1).where("dropped_lines = 0 or text <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("dropped_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join.

    A document is its id and text, so rows of one id or of none are compared by
    their texts; the one whose hash of both is smallest stays.  Of rows equal in
    both, one stays (the first by its other columns as JSON); documents without
    words link with nothing and all stay.
    """
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("__key"), "text")
    found = Scratch(spark).cut(ngram_components(keyed, "__key"), "components")
    stays = found.where("__key = component_id").groupBy("__key").agg(F.count("*").alias("n"), F.max("n_shingles").alias("words"))
    stays = Scratch(spark).cut(stays.select("__key", ((F.col("n") > 1) & (F.col("words") > 0)).alias("__again")), "stays")
    if stays.where("__again").isEmpty():
        return docs.join(stays, key == F.col("__key"), "left_semi")
    out = docs.join(stays, key == F.col("__key"))
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rest).alias("__row")
    one = out.where("__again").groupBy("__key").agg(row).select("__row.*")
    return out.where("not __again").select(*[F.col(f"`{c}`") for c in docs.columns]).union(one)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own, a null text has no words, and a
    document that the mix does not take goes.
    """
    docs, columns = _aside(docs, ("size", "source_size", "target", "copies", "taken"))
    mixed = mix_sources(docs.withColumn("__weight", quality_weight("text")), weight_col="__weight").where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every word of every document goes; nulls and repeated rows as in ``pack``."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the MinHash bands nor the fitted classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
