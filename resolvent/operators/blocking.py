"""Candidate generation by equi joins on derived keys (JOIN).

Keys that too many records share are capped by a total order of ids (never by
arrival), so every join's output is bounded by the number of records times a cap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import io

#: Keys beyond the cap that may be broadcast, to leave their rows out before a shuffle; more are left out by the join.
HOT_KEYS = 300_000


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi join that shuffles and merges both sides.

    Spark estimates a table by the size of its files, before rows are exploded or
    compressed columns read, and would broadcast tables far beyond its threshold.
    """
    return left.join(right.hint("merge"), on, how)


def exact_block(left: DataFrame, right: DataFrame, keys: list[str], left_id: str = "s1_id", right_id: str = "target_id", shortest: int = 1) -> DataFrame:
    """Pairs that agree on all keys; keys shorter than ``shortest`` match nothing."""
    ok = F.length(F.col(keys[-1])) >= shortest
    return merged(left.where(ok).select(left_id, *keys), right.where(ok).select(right_id, *keys), keys).select(left_id, right_id)


def unique(df: DataFrame, by: str) -> bool:
    """Whether no value of ``by`` repeats."""
    return df.groupBy(by).count().where("count > 1").isEmpty()


def disjunctive_block(left: DataFrame, right: DataFrame, always: list[str], either: list[str], left_id: str = "s1_id", right_id: str = "target_id") -> DataFrame:
    """Pairs that agree on ``always`` and on one of ``either``: one equi join each, a pair coming from the first key it agrees on.

    Pairs are compared with each other only where ids repeat on a side.
    """
    out, before = None, F.lit(False)
    a, b = (lambda k: f"__l_{k}"), (lambda k: f"__r_{k}")
    for i, k in enumerate(either):
        ok = F.length(k) >= 1
        l = left.where(ok).select(left_id, *always, k, *[F.col(x).alias(a(x)) for x in either[:i]])
        r = right.where(ok).select(right_id, *always, k, *[F.col(x).alias(b(x)) for x in either[:i]])
        part = merged(l, r, [*always, k]).where(~before).select(left_id, right_id)
        out = part if out is None else out.unionByName(part)
        before = before | F.coalesce((F.col(a(k)) == F.col(b(k))) & (F.length(a(k)) >= 1), F.lit(False))
    return out if unique(left, left_id) and unique(right, right_id) else out.dropDuplicates([left_id, right_id])


def capped(df: DataFrame, keys: list[str], by: str, cap: int) -> DataFrame:
    """At most ``cap`` rows per key, those with the smallest ``by``; planned as a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(by)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= cap).drop("__rn")


def first_in_block(left: DataFrame, right: DataFrame, keys: list[str], cap: int, left_id: str = "s1_id", right_id: str = "target_id", shortest: int = 1) -> DataFrame:
    """``exact_block`` with the first ``cap`` targets of each left record by id.

    A left row meets one key, so the index holds the first ``cap`` rows of a key and
    the join makes no row that the cut would take away; pairs are cut again only
    where left ids repeat.
    """
    index = capped(right.where(F.length(F.col(keys[-1])) >= shortest).select(right_id, *keys), keys, right_id, cap)
    pairs = exact_block(left, index, keys, left_id, right_id, shortest)
    return pairs if unique(left, left_id) else capped(pairs, [left_id], right_id, cap)


def token_block(left: DataFrame, right: DataFrame, left_tokens: Column, right_tokens: Column, always: list[str], cap: int, take: int, left_id: str = "s1_id", right_id: str = "target_id", shortest: int = 1) -> DataFrame:
    """Pairs that share a word: ``right`` is an index of at most ``cap`` postings a word, a left record takes ``take`` of each word's.

    Both are the first by id, so the index holds no more than the smaller of the
    two and the join makes no row that the cut would take away.
    """
    index = right.select(right_id, *always, F.explode(F.array_distinct(right_tokens)).alias("token")).where(F.length("token") >= shortest)
    index = capped(index, [*always, "token"], right_id, min(cap, take))
    asked = left.select(left_id, *always, F.explode(F.array_distinct(left_tokens)).alias("token")).where(F.length("token") >= shortest)
    return merged(asked, index, [*always, "token"]).select(left_id, right_id).distinct()


def multi_keys(country: Column, name_tokens: Column, address_tokens: Column, numbers: Column) -> Column:
    """Hashed keys of several kinds with their family, as an array of (family, key).

    The first words are bound once, for an expression inside a lambda is evaluated for
    every element; repeats go within a family, whose keys are longs that Spark hashes.
    """
    key = lambda kind, *c: F.xxhash64(F.lit(kind), country, *c)
    one = lambda kind, arr: F.transform(arr, lambda t: key(kind, t))
    bound = lambda x, body: F.flatten(F.transform(F.array(x), body))
    firsts = F.slice(F.sort_array(name_tokens), 1, 4)
    pairs = bound(firsts, lambda f: F.flatten(F.transform(f, lambda a: F.transform(F.filter(f, lambda b: b > a), lambda b: key("pair", a, b)))))
    prefixes = F.transform(name_tokens, lambda t: key("pre4", F.substring(t, 1, 4)))
    cross = bound(F.slice(numbers, 1, 3), lambda d: F.flatten(F.transform(firsts, lambda a: F.transform(d, lambda b: key("name+number", a, b)))))
    family = lambda fam, *ks: F.transform(F.array_distinct(F.concat(*ks)), lambda k: F.struct(F.lit(fam).alias("family"), k.alias("key")))
    return F.concat(family("name", one("token", name_tokens), prefixes, pairs), family("address", one("token", address_tokens), one("number", numbers)), family("cross", cross))


def weighted_key_join(left: DataFrame, right: DataFrame, cap: int, left_id: str = "s1_id", right_id: str = "target_id") -> DataFrame:
    """(left, right, score, n_keys and sums by family) from (id, family, key) rows on both sides.

    A key's weight is ln((N + 1) / (c + 1)) with c its postings on the right;
    keys with more than ``cap`` postings are left out.  The score is the cosine
    of the key sets: total / sqrt((mass_left + 1)(mass_right + 1)).

    Keys are made once a side.  Those left out go before the shuffle, and a left key
    meets a list of at most ``cap`` postings, so what is dealt by left ids has a row
    for a key and not for a pair.
    """
    right = _written(right.select(right_id, "key"), "right_keys")
    n = right.select(right_id).distinct().count()
    counts = _written(right.groupBy("key").agg(F.count("*").alias("c")), "key_counts")
    hot = counts.where(F.col("c") > cap).select("key")
    freq = counts.where(F.col("c") <= cap).select("key", F.log(F.lit(n + 1) / (F.col("c") + 1)).alias("w"))
    if 0 < hot.count() <= HOT_KEYS:
        left, right = (x.join(F.broadcast(hot), "key", "left_anti") for x in (left, right))
    left = _written(left.select(left_id, "family", "key"), "left_keys")
    lw, rw = merged(left, freq, ["key"]), merged(right, freq, ["key"])
    lm = lw.groupBy(left_id).agg(F.sum("w").alias("lm"))
    rm = rw.groupBy(right_id).agg(F.sum("w").alias("rm"))
    lists = merged(rw.select(right_id, "key"), rm, [right_id]).groupBy("key").agg(F.collect_list(F.struct(right_id, "rm")).alias("met"))
    met = merged(merged(lw, lists, ["key"]).select(left_id, "family", "w", "met"), lm, [left_id])
    met = met.select(left_id, "lm", "family", "w", F.explode("met").alias("met")).select(left_id, "lm", "family", "w", "met.*")
    fam = lambda f: F.sum(F.when(F.col("family") == f, F.col("w")).otherwise(0.0)).alias(f"bs_{f}")
    pairs = met.groupBy(left_id, right_id).agg(F.sum("w").alias("total"), F.count("*").alias("n_keys"), F.max("lm").alias("lm"), F.max("rm").alias("rm"), fam("name"), fam("address"), fam("cross"))
    return pairs.withColumn("score", F.col("total") / F.sqrt((F.col("lm") + 1) * (F.col("rm") + 1))).drop("lm", "rm")


def _written(df: DataFrame, name: str) -> DataFrame:
    df.write.parquet(path := io.work_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fuse(channels: list[tuple[DataFrame, float | None]], left_id: str = "s1_id", right_id: str = "target_id") -> DataFrame:
    """(left, right, score, votes): the largest score over channels and how many channels found the pair.

    A channel comes with a constant score, or with None and a column ``score``.
    """
    rows = [c.select(left_id, right_id, (F.lit(s) if s is not None else F.col("score")).cast("double").alias("score"), F.lit(i).alias("channel")) for i, (c, s) in enumerate(channels)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy(left_id, right_id).agg(F.max("score").alias("score"), F.count_distinct("channel").alias("votes"))


def pruned(candidates: DataFrame, score: Callable[[DataFrame], DataFrame], keep: int, likely: float, left_id: str = "s1_id", right_id: str = "target_id") -> DataFrame:
    """Candidates that a pluggable pre-ranker (candidates to the same with ``prob``) ranks among the first ``keep`` or thinks ``likely``."""
    x = score(candidates).withColumn("prob", F.round("prob", 9))
    w = Window.partitionBy(left_id).orderBy(F.desc("prob"), right_id)
    return x.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= keep) | (F.col("prob") >= likely))


def in_parts(queries: DataFrame, rows: int, by: str = "s1_id") -> DataFrame:
    """Queries dealt into partitions of about ``rows``, so that a task's share of a retrieval is bounded."""
    return queries.repartition(max(1, -(-queries.count() // rows)), by)


def budgeted_join(left: DataFrame, right: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """The equi join, with every key's pairs dealt over cells of about ``budget`` pairs.

    A key's rows are dealt by a hash into blocks on both sides, and every two blocks
    meet in a cell.  Blocks are about as long on either side, where rows allow, so a
    row is sent to few cells.
    """
    n = float(budget)
    size = merged(left.groupBy(*keys).agg(F.count("*").alias("__l")), right.groupBy(*keys).agg(F.count("*").alias("__r")), keys)
    long = F.least(F.col("__l").cast("double"), F.greatest(F.lit(n**0.5), F.lit(n) / F.col("__r")))  # rows of a left block
    size = size.select(*keys, F.ceil(F.col("__l") / long).cast("long").alias("__p"), F.ceil(F.col("__r") * long / F.lit(n)).cast("long").alias("__q"))

    def dealt(df, own, blocks, other, others):
        block = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.col(blocks)).alias(own)
        return df.join(size, keys).select(*df.columns, block, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias(other))

    return merged(dealt(left, "__i", "__p", "__j", "__q"), dealt(right, "__j", "__q", "__i", "__p"), [*keys, "__i", "__j"]).drop("__i", "__j")
