"""Evaluation of candidates and decisions against truth pairs (EVAL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f_beta(p: Column, r: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.when(p + r > 0, (1 + b) * p * r / (b * p + r)).otherwise(0.0)


def f_counts(tp: Column, fp: Column, fn: Column, beta: float = 0.5) -> Column:
    """F-beta from counts; 1 where there is nothing to find and nothing found."""
    b = beta * beta
    bottom = (1 + b) * tp + b * fn + fp
    return F.when(bottom == 0, 1.0).otherwise((1 + b) * tp / bottom)


def per_record(s1: DataFrame, predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, tp, n_pred, n_true, f05) for every id of ``s1``."""
    pred = predictions.select("s1_id", "target_id").distinct()
    true = truth.select("s1_id", "target_id").distinct()
    both = pred.withColumn("p", F.lit(1)).join(true.withColumn("t", F.lit(1)), ["s1_id", "target_id"], "full")
    counts = both.groupBy("s1_id").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count("p").alias("n_pred"), F.count("t").alias("n_true"))
    x = s1.select("s1_id").distinct().join(counts, "s1_id", "left").fillna(0, ["tp", "n_pred", "n_true"])
    return x.withColumn("f05", f_counts(F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp")))


def macro_f05(s1: DataFrame, predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: macro F0.5, micro precision and recall, and how many singletons were left alone."""
    x = per_record(s1, predictions, truth)
    return x.agg(
        F.round(F.avg("f05"), 9).alias("macro_f05"), F.round(F.sum("tp") / F.sum("n_pred"), 9).alias("precision"), F.round(F.sum("tp") / F.sum("n_true"), 9).alias("recall"),
        F.count_if((F.col("n_true") == 0) & (F.col("n_pred") == 0)).alias("singletons_kept"), F.count("*").alias("records"),
    )


def candidate_quality(s1: DataFrame, targets: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: recall, pairs, mean and high quantiles per record, and the reduction ratio."""
    c = candidates.select("s1_id", "target_id").distinct()
    sizes = s1.select("s1_id").join(c.groupBy("s1_id").count(), "s1_id", "left").fillna(0, ["count"])
    a = sizes.agg(F.sum("count").alias("pairs"), F.round(F.avg("count"), 9).alias("mean"), F.expr("percentile(count, 0.95)").alias("p95"), F.max("count").alias("most"), F.count("*").alias("n1"))
    hits = truth.join(c, ["s1_id", "target_id"], "left_semi").agg(F.count("*").alias("hits"))
    x = a.join(hits).join(truth.agg(F.count("*").alias("n_true"))).join(targets.agg(F.count("*").alias("n2")))  # one row each
    return x.select("pairs", "hits", F.round(F.col("hits") / F.col("n_true"), 9).alias("recall"), "mean", "p95", "most", F.round(1 - F.col("pairs") / (F.col("n1").cast("double") * F.col("n2")), 12).alias("reduction"))


def recall_at(candidates: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(k, hits, recall) in one pass: hits by rank, then a running sum at each k."""
    hits = candidates.join(truth.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_semi").groupBy("rank").agg(F.count("*").alias("n"))
    grid = truth.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    x = F.broadcast(grid).join(hits, F.col("rank") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))  # a row per rank
    return x.join(truth.agg(F.count("*").alias("n_true"))).select("k", "hits", F.round(F.col("hits") / F.col("n_true"), 9).alias("recall"))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n, tp, precision, recall, f05) over (prob, label), grid broadcast."""
    grid = scored.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    total = scored.agg(F.sum("label").alias("all_true"))
    x = scored.join(F.broadcast(grid), F.col("prob") >= F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("n"), F.sum("label").alias("tp"))
    x = x.join(F.broadcast(total))  # one row
    return x.select("threshold", "n", "tp", F.round(F.col("tp") / F.col("n"), 9).alias("precision"), F.round(F.col("tp") / F.col("all_true"), 9).alias("recall"), F.round(f_counts(F.col("tp"), F.col("n") - F.col("tp"), F.col("all_true") - F.col("tp")), 9).alias("f05"))


def policy_grid(scored: DataFrame, thresholds: list[float], margins: list[float]) -> DataFrame:
    """(threshold, margin, n, tp) over a grid of the score-and-margin rule."""
    g = Window.partitionBy("s1_id")
    x = scored.withColumn("top", F.max("prob").over(g))
    x = x.withColumn("r", F.row_number().over(g.orderBy(F.desc("prob"), "target_id")))
    x = x.withColumn("gap", F.col("top") - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("prob"))).over(g), F.lit(-1.0)))
    grid = scored.sparkSession.createDataFrame([(t, m) for t in thresholds for m in margins], "threshold double, margin double")
    x = x.join(F.broadcast(grid), (F.col("prob") >= F.col("threshold")) & (F.col("gap") >= F.col("margin")))
    return x.groupBy("threshold", "margin").agg(F.count("*").alias("n"), F.sum("label").alias("tp"))


def separation(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: ROC-AUC (ties half) and KS, from a running sum over distinct scores."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("p"), (F.count("*") - F.sum(label)).alias("n"))
    tot = by.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)  # a row per distinct score
    x = by.withColumn("cp", F.sum("p").over(w)).withColumn("cn", F.sum("n").over(w)).join(F.broadcast(tot))
    auc = F.try_divide(F.sum(F.col("p") * (F.col("cn") - F.col("n") / 2.0)), F.first("tp") * F.first("tn"))  # null with one class only
    ks = F.max(F.abs(F.try_divide("cp", "tp") - F.try_divide("cn", "tn")))
    return x.agg(F.round(auc, 9).alias("auc"), F.round(ks, 9).alias("ks"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: PR-AUC as average precision, over distinct scores from the largest."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    tot = by.agg(F.sum("p").alias("tp"))
    w = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)  # a row per distinct score
    x = by.withColumn("cp", F.sum("p").over(w)).withColumn("cn", F.sum("n").over(w)).join(F.broadcast(tot))  # one row
    return x.agg(F.round(F.sum(F.try_divide("p", "tp") * F.col("cp") / F.col("cn")), 9).alias("pr_auc"))


def brier(df: DataFrame, prob: str, label: str) -> DataFrame:
    """One row: the mean squared difference of probability and label."""
    return df.agg(F.round(F.avg((F.col(prob) - F.col(label)) * (F.col(prob) - F.col(label))), 9).alias("brier"))


def output_contract(s1: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(check, bad): ids missing, ids repeated, matches that are no candidates, repeated pairs; all should be 0."""
    lists = s1.select("s1_id")
    missing = lists.join(matches.select("s1_id"), "s1_id", "left_anti").agg(F.count("*").alias("bad")).select(F.lit("missing").alias("check"), "bad")
    alien = matches.where("target_id is not null").join(candidates, ["s1_id", "target_id"], "left_anti").agg(F.count("*").alias("bad")).select(F.lit("not_candidate").alias("check"), "bad")
    twice = matches.groupBy("s1_id", "target_id").count().where("count > 1").agg(F.count("*").alias("bad")).select(F.lit("repeated").alias("check"), "bad")
    return missing.union(alien).union(twice)
