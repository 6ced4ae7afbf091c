"""TF-IDF retrieval as posting joins (IR).

Term weights are (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), L2-normalised per
record, with the document frequencies of the targets.  Scores are sums over
shared terms, so the plan is two aggregations and one equi join on the term; the
terms that most records share are dropped by ``max_df`` before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import few_queries, short_texts
from .blocking import merged


def term_counts(df: DataFrame, id_col: str, terms, keys: list[str]) -> DataFrame:
    """(id, keys, term, tf)."""
    return df.select(id_col, *keys, F.explode(terms).alias("term")).groupBy(id_col, *keys, "term").agg(F.count("*").alias("tf"))


def idf_table(counts: DataFrame, n_docs: DataFrame, keys: list[str], min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(keys, term, df, idf) from counts; ``n_docs`` is (keys, n); the vocabulary keeps the ``max_features`` most frequent terms."""
    df = counts.groupBy(*keys, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    joined = merged(df, n_docs, keys) if keys else df.join(F.broadcast(n_docs))  # one row
    joined = joined.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    if max_features is not None and keys:
        w = Window.partitionBy(*keys).orderBy(F.desc("total"), "term")
        joined = joined.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_features)
    elif max_features is not None:
        joined = joined.orderBy(F.desc("total"), "term").limit(max_features)
    return joined.select(*keys, "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(counts: DataFrame, idf: DataFrame, id_col: str, keys: list[str], top: int | None = None) -> DataFrame:
    """(id, keys, term, w) with unit length per record; with ``top`` only its heaviest terms, normalised again."""
    x = merged(counts, idf, [*keys, "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    if top is not None:
        rank = Window.partitionBy(id_col).orderBy(F.desc("w"), "term")
        x = x.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= top)
    norm = x.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return merged(x, norm, [id_col]).select(id_col, *keys, "term", (F.col("w") / F.col("norm")).alias("w"))


def cosine_top_k(queries: DataFrame, targets: DataFrame, keys: list[str], k: int, least: float = 0.0, left_id: str = "s1_id", right_id: str = "target_id") -> DataFrame:
    """(left, right, score, rank): the k targets of largest cosine, ties by id."""
    q = queries.select(left_id, *keys, "term", F.col("w").alias("wq"))
    t = targets.select(right_id, *keys, "term", F.col("w").alias("wt"))
    pairs = merged(q, t, [*keys, "term"]).groupBy(left_id, right_id).agg(F.sum(F.col("wq") * F.col("wt")).alias("score"))
    # Scores are compared as rounded, so ties do not hang on the order of a sum.
    pairs = pairs.withColumn("score", F.round("score", 9)).where(F.col("score") > least)
    w = Window.partitionBy(left_id).orderBy(F.desc("score"), right_id)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieve(queries: DataFrame, targets: DataFrame, query_terms, target_terms, keys: list[str] | None = None, k: int = 30, least: float = 0.0, min_df: int = 1, max_df: float = 1.0, top: int | None = None, max_features: int | None = None, joint: bool = False, left_id: str = "s1_id", right_id: str = "target_id", short: bool = False, few: tuple[str, int | None] | None = None) -> DataFrame:
    """Index ``targets`` and retrieve for every query record; ``joint`` counts terms over both sides.

    ``short`` texts with ids that are strings, neither null nor repeated, are scored by inverted
    lists inside tasks if their vocabulary can be broadcast; the result is the same.
    ``few`` queries over many long texts name the column whose words (or distinct n-grams) the
    terms are, as (column, None or n), and are scored text by text, with the same result.
    """
    keys = keys or []
    if few is not None and not keys and not joint and top is None and max_features is None and short_texts.plain_ids(queries, left_id) and short_texts.plain_ids(targets, right_id):
        found = few_queries.top_k(queries, targets, *few, k, least, min_df, max_df, left_id, right_id)
        if found is not None:
            return found
    tc = term_counts(targets, right_id, target_terms, keys)
    qc = term_counts(queries, left_id, query_terms, keys)
    seen, ids = tc, targets.select(F.col(right_id).alias("id"), *keys)
    if joint:
        seen = tc.select(*keys, "term", "tf").unionByName(qc.select(*keys, "term", "tf"))
        ids = ids.unionByName(queries.select(F.col(left_id).alias("id"), *keys))
    n = ids.groupBy(*keys).agg(F.count_distinct("id").alias("n"))
    idf = idf_table(seen, n, keys, min_df, max_df, max_features)
    if short and short_texts.plain_ids(queries, left_id) and short_texts.plain_ids(targets, right_id):
        found = short_texts.top_k(queries, targets, query_terms, target_terms, idf, keys, k, least, top, left_id, right_id)
        if found is not None:
            return found
    return cosine_top_k(weighted(qc, idf, left_id, keys, top), weighted(tc, idf, right_id, keys, top), keys, k, least, left_id, right_id)


def weak_queries(queries: DataFrame, found: DataFrame, least_top: float = 0.35, least_hits: int = 5, left_id: str = "s1_id") -> DataFrame:
    """Queries with no hit, a weak best hit or few hits."""
    stats = found.groupBy(left_id).agg(F.max("score").alias("top"), F.count("*").alias("hits"))
    x = queries.select(left_id).join(stats, left_id, "left")
    return x.where(F.col("top").isNull() | (F.col("top") < least_top) | (F.col("hits") < least_hits)).select(left_id)
