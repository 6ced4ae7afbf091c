"""Decisions over scored candidates (DEC): (s1_id, target_id, prob) in, kept rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import capped_by_source, group_context



def group():
    """The candidates of a record."""
    return Window.partitionBy("s1_id")


def by_prob():
    """The candidates of a record, the most probable first."""
    return group().orderBy(F.desc("prob"), "target_id")


#: Thresholds of the pipelines this engine stands for.
PRESETS = {"g1": {"threshold": 0.75, "floor": 0.40}, "g2": {"tau_s2": 0.72, "tau_s3": 0.75, "floor": 0.40}, "g3": {"threshold": 0.58}}


def threshold_policy(df: DataFrame, threshold: float = 0.72, floor: float = 0.40) -> DataFrame:
    """Nothing for a record whose best is under the floor, else all at or over the threshold."""
    return df.withColumn("__top", F.max("prob").over(group())).where((F.col("__top") >= floor) & (F.col("prob") >= threshold)).drop("__top")


def source_threshold(tau_s2: float = 0.72, tau_s3: float = 0.75) -> Column:
    return F.when(F.col("target_id").startswith("S3-"), tau_s3).otherwise(tau_s2)


def source_thresholds(df: DataFrame, tau_s2: float = 0.72, tau_s3: float = 0.75) -> DataFrame:
    return df.where(F.col("prob") >= source_threshold(tau_s2, tau_s3))


def singleton_tiers(df: DataFrame, a: float = 0.82, b: float = 0.68, margin: float = 0.12, floor: float = 0.40, evidence: Column | None = None) -> DataFrame:
    """Adds tier: C (nothing), A (accept) or B (verify); ``evidence`` is a Column that the best row must meet."""
    x = group_context(df, score="prob")
    lead = F.col("top") - F.greatest("second", F.lit(0.0))
    proof = F.max(F.when(F.col("rank") == 1, F.coalesce(evidence, F.lit(False)) if evidence is not None else F.lit(False))).over(group())
    tier = (
        F.when(F.col("top") < floor, "C")
        .when((F.col("top") >= a) & ((lead >= margin) | (F.col("size") == 1)), "A")
        .when(F.col("top") >= b, F.when(proof, "A").when((lead < 0.05) & (F.col("top") < 0.75), "C").otherwise("B"))
        .otherwise("C")
    )
    return x.withColumn("tier", tier).select(*df.columns, "rank", "top", "tier")


def expected_f_legacy(df: DataFrame) -> DataFrame:
    """The prefix of largest expected F with recall taken as 1: only ties of the best survive."""
    x = df.withColumn("__k", F.row_number().over(by_prob()))
    mean = F.sum("prob").over(by_prob().rowsBetween(Window.unboundedPreceding, 0)) / F.col("__k")
    x = x.withColumn("__f", F.round(1.25 * mean / (0.25 * mean + 1), 12))
    best = F.max(F.struct("__f", "__k")).over(group())["__k"]
    return x.withColumn("__best", best).where(F.col("__k") <= F.col("__best")).drop("__k", "__f", "__best")


def dynamic_expected_f(df: DataFrame, most: int = 8, each: int = 5) -> DataFrame:
    """The prefix of up to ``most`` rows with the largest expected F0.5, misses left out; then ``each`` per source."""
    x = df.withColumn("__k", F.row_number().over(by_prob())).where(F.col("__k") <= most)
    total = F.sum("prob").over(by_prob().rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("__f", F.round(1.25 * total / (F.col("__k") + 0.25 * F.greatest(total, F.lit(1e-4))), 12))
    best = F.max(F.struct("__f", (-F.col("__k")).alias("__k"))).over(group())["__k"]
    return capped_by_source(x.withColumn("__best", -best).where(F.col("__k") <= F.col("__best")).drop("__k", "__f", "__best"), each, None)


def expected_f_select(df: DataFrame, miss: float = 0.0, power: float = 1.0) -> DataFrame:
    """The prefix of largest expected F0.5 with the expected number of true matches held fixed.

    E[T] is the sum of all probabilities and ``miss``; the empty set scores the
    probability that nothing is true and wins if that is larger.
    """
    x = df.withColumn("__q", F.least(F.pow("prob", F.lit(power)), F.lit(1 - 1e-7))).withColumn("__k", F.row_number().over(by_prob()))
    x = x.withColumn("__tp", F.sum("__q").over(by_prob().rowsBetween(Window.unboundedPreceding, 0))).withColumn("__t", F.sum("__q").over(group()) + miss)
    x = x.withColumn("__empty", F.exp(F.sum(F.log1p(-F.col("__q"))).over(group())))
    x = x.withColumn("__f", F.round(1.25 * F.col("__tp") / (F.col("__k") + 0.25 * F.col("__t")), 12))
    best = F.max(F.struct("__f", (-F.col("__k")).alias("__n"))).over(group())
    x = x.withColumn("__best", best)
    return x.where((F.col("__k") <= -F.col("__best.__n")) & (F.col("__best.__f") >= F.col("__empty"))).drop("__q", "__k", "__tp", "__t", "__empty", "__f", "__best")


def full_engine(df: DataFrame, tau_s2: float = 0.72, tau_s3: float = 0.75, legacy: bool = False, evidence: Column | None = None, rescue: float = 0.70) -> DataFrame:
    """Tiers, thresholds by source, rescue of a decisive best, expected F and caps, in that order."""
    x = singleton_tiers(df, evidence=evidence).where("tier <> 'C'")
    passes = F.col("prob") >= source_threshold(tau_s2, tau_s3)
    x = x.withColumn("__any", F.max(passes.cast("int")).over(group())).where(passes | ((F.col("__any") == 0) & (F.col("tier") == "A") & (F.col("rank") == 1) & (F.col("top") >= rescue)))
    chosen = (expected_f_legacy if legacy else expected_f_select)(x.select(*df.columns))
    return capped_by_source(chosen, 5, None)


def resolve_collisions(df: DataFrame, margin: float = 0.15) -> DataFrame:
    """A target that several records claim goes to the best one if it leads by ``margin``, else to all."""
    w = Window.partitionBy("target_id")
    o = w.orderBy(F.desc("prob"), "s1_id")
    x = df.withColumn("__r", F.row_number().over(o))
    x = x.withColumn("__1", F.max(F.when(F.col("__r") == 1, F.col("prob"))).over(w)).withColumn("__2", F.max(F.when(F.col("__r") == 2, F.col("prob"))).over(w))
    return x.where(F.col("__2").isNull() | (F.round(F.col("__1") - F.col("__2"), 9) < margin) | (F.col("__r") == 1)).drop("__r", "__1", "__2")


def one_to_one(df: DataFrame) -> DataFrame:
    """Every target's best record keeps it."""
    o = Window.partitionBy("target_id").orderBy(F.desc("prob"), "s1_id")
    return df.withColumn("__r", F.row_number().over(o)).where("__r = 1").drop("__r")


def threshold_or_best(df: DataFrame, threshold: float, min_top: float) -> DataFrame:
    """All at the threshold, and the best one from ``min_top`` on."""
    return df.withColumn("__r", F.row_number().over(by_prob())).where((F.col("prob") >= threshold) | ((F.col("__r") == 1) & (F.col("prob") >= min_top))).drop("__r")


def singleton_gate(df: DataFrame, least: float) -> DataFrame:
    return df.withColumn("__top", F.max("prob").over(group())).where(F.col("__top") >= least).drop("__top")


def score_margin(df: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Rows at the threshold of records whose best leads by ``margin``."""
    x = group_context(df, score="prob")
    return x.where((F.col("prob") >= threshold) & ((F.col("size") == 1) | (F.col("topgap") >= margin))).select(*df.columns)


def best_or_singleton(df: DataFrame, low: float = 0.4, high: float = 0.6, margin: float = 0.1) -> DataFrame:
    """(s1_id, singleton): the best is under ``low``, or under ``high`` with a small lead."""
    x = group_context(df, score="prob").where("rank = 1")
    alone = (F.col("top") < low) | ((F.col("top") < high) & (F.col("topgap") < margin))
    return x.select("s1_id", alone.alias("singleton"))


def missing_address_rule(df: DataFrame, flat: float = 0.70, relaxed: float = 0.50, name: float = 0.88, score: float = 0.60) -> DataFrame:
    """The flat threshold, or a lower one without an address if the names and the retrieval agree."""
    return df.where((F.col("prob") >= flat) | (F.col("addr_missing") & (F.col("prob") >= relaxed) & (F.col("name_sim") >= name) & (F.col("score") >= score)))


def plaza_filter(df: DataFrame, least: float = 0.45, shortest: int = 3) -> DataFrame:
    """Drops pairs of Latin names of ``shortest`` characters or more that share no word and look different."""
    latin = lambda c: F.col(c).rlike("^[\\x00-\\x7F]*$") & (F.length(c) >= shortest)
    bad = latin("name_a") & latin("name_b") & (F.size(F.array_intersect(F.split("name_a", " "), F.split("name_b", " "))) == 0) & (F.col("name_sim") < least)
    return df.where(~bad)


def band_route(df: DataFrame, low: float, high: float, rescore, blend: float = 0.5) -> DataFrame:
    """Accept at ``high``, reject under ``low``; between, blend with ``rescore`` (DataFrame to DataFrame with prob2)."""
    x = df.withColumn("band", F.when(F.col("prob") >= high, "accept").when(F.col("prob") < low, "reject").otherwise("check"))
    rest = x.where("band <> 'check'")
    check = rescore(x.where("band = 'check'")).withColumn("prob", F.round((1 - blend) * F.col("prob") + blend * F.col("prob2"), 9)).drop("prob2")
    return rest.unionByName(check.select(*rest.columns))


def recover_unclaimed(kept: DataFrame, before: DataFrame) -> DataFrame:
    """``kept`` and the former rows of records that lost all, if each of their targets had one owner and nobody has it now."""
    lost = before.join(kept.select("s1_id").distinct(), "s1_id", "left_anti")
    owners = before.groupBy("target_id").agg(F.count_distinct("s1_id").alias("owners"))
    now = kept.select("target_id", F.lit(True).alias("claimed")).distinct()
    x = lost.join(owners, "target_id").join(now, "target_id", "left")
    fine = (F.col("owners") == 1) & F.col("claimed").isNull()
    bad = x.where(~fine).select("s1_id").distinct()
    return kept.unionByName(x.join(bad, "s1_id", "left_anti").select(*kept.columns))


def max_merge(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("s1_id", "target_id").agg(F.max("prob").alias("prob"))
