"""Operator 10: quality rules per document and per host.

DataFrame operations only.  Each document is held against rules on its words;
failures are aggregated by host, a host's rate is shrunk towards all hosts by a
beta prior fitted to them (method of moments), and the host's verdict is joined
back to its documents.

Repeated 3-word windows are found inside the row: windows are hashed, sorted
with their positions, and neighbours compared, so no word leaves its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Rows of the table of hosts up to which it is broadcast.
BROADCAST_ROWS = 20_000


def text_measures(text: str) -> dict:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a column as native expressions."""
    t = f"coalesce(`{text}`, '')"
    words = f"filter(split({t}, '[\\\\x20\\\\x09-\\\\x0D]+', -1), w -> w <> '')"
    return {
        "__words": F.expr(words),
        "n_symbols": (F.length(F.expr(t)) - F.length(F.translate(F.expr(t), "#*$%&|<>", ""))).cast("long"),
        "__lines": F.expr(f"filter(split({t}, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
    }


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the measures of its text (long)."""
    x = docs.withColumns(text_measures(text_col))
    x = x.withColumn("n_words", F.size("__words").cast("long"))
    x = x.withColumn("word_chars", F.length(F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), " \t\n\x0b\x0c\r", "")).cast("long"))
    x = x.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    # Sorted (hash, position) of all windows; those equal to a neighbour stay.
    x = x.withColumn("__w", F.expr("""
        case when n_words < 4 then array()
        else array_sort(transform(sequence(0, cast(n_words as int) - 3),
             i -> struct(xxhash64(__words[i], __words[i + 1], __words[i + 2]) as h, i as p))) end"""))
    x = x.withColumn("__p", F.expr("""
        array_sort(transform(filter(__w, (x, i) -> (i > 0 and x.h = __w[i - 1].h) or (i < size(__w) - 1 and x.h = __w[i + 1].h)), x -> x.p))"""))
    # A window covers three words, less where the next one begins.
    x = x.withColumn("n_repeat_words", F.expr("""
        cast(aggregate(transform(__p, (p, i) -> case when i < size(__p) - 1 then least(3, __p[i + 1] - p) else 3 end), 0, (a, b) -> a + b) as bigint)"""))
    return x.drop("__words", "__lines", "__w", "__p")


def host_verdicts(failures: DataFrame, most: float = 0.5) -> DataFrame:
    """(host, n, failed, rate, host_ok) from (host, n, failed).

    The prior is Beta(a, b) with the mean and variance of the hosts' rates, the
    variance less what sampling alone would give; a + b is between 1 and 1e6.
    A host is rejected if its shrunk rate (failed + a) / (n + a + b) exceeds
    ``most``.  A null host gets no verdict.
    """
    seen = failures.where("host is not null")
    r = F.col("failed") / F.col("n")
    fit = seen.agg(F.sum("failed").alias("sf"), F.sum("n").alias("sn"), F.avg(r).alias("m1"), F.var_pop(r).alias("v"), F.avg(1 / F.col("n")).alias("inv"))
    mean = F.col("sf") / F.col("sn")
    noise = mean * (1 - mean) * F.col("inv")
    spread = F.greatest(F.col("v") - noise, F.lit(1e-9))
    strength = F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(1.0)), F.lit(1e6))
    fit = fit.select(mean.alias("mean"), strength.alias("strength"))
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    both = seen.join(F.broadcast(fit))  # one row
    return both.select("host", "n", "failed", shrunk.alias("rate"), (shrunk <= most).alias("host_ok"))


def rule_verdicts(docs: DataFrame, text_col: str = "text", host_col: str = "source", most: float = 0.5) -> DataFrame:
    """``docs`` without its text but with measures, base_failed, rules_failed, host_rate and kept.

    ``base_failed``: fewer than 50 words, or over half of the words stand in
    3-word windows found twice or more.  ``rules_failed`` adds rules on symbols
    (over 1 per 10 words), repeated lines (3 or more, and over 1 per 20 words)
    and mean word length (outside 2 to 16 code points).  A document is kept if
    it passes these rules and its host's shrunk rate of failures is at most
    ``most``.  A null text has no words and so fails; a null host gives no
    verdict, only its documents' own rules count.  Columns of ``docs`` named
    like the new ones are replaced; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    new = ["n_words", *MEASURES, "base_failed", "rules_failed", "host_rate", "kept"]
    keep = [c for c in docs.columns if c not in new and c != text_col]
    x = measured(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{host_col}`").alias("__host"), F.col(f"`{text_col}`").alias("__text")), "__text").drop("__text")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    also = (10 * F.col("n_symbols") > F.col("n_words")) | ((F.col("n_dup_lines") >= 3) & (20 * F.col("n_dup_lines") > F.col("n_words")))
    also = also | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 16 * F.col("n_words"))
    x = scratch.cut(x.withColumn("base_failed", base).withColumn("rules_failed", base | also), "measures")
    failures = x.groupBy(F.col("__host").alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("rules_failed").cast("long")).alias("failed"))
    hosts = scratch.cut(host_verdicts(failures, most), "hosts")
    hosts = hosts.select(F.col("host").alias("__host2"), F.col("rate").alias("host_rate"), "host_ok")
    if hosts.count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    x = x.join(hosts, F.col("__host") == F.col("__host2"), "left")
    kept = ~F.col("rules_failed") & F.coalesce("host_ok", F.lit(True))
    return x.select(*[F.col(f"`{c}`") for c in keep], "n_words", *MEASURES, "base_failed", "rules_failed", "host_rate", kept.alias("kept"))


MEASURES = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def op10_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rule_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", *MEASURES, "base_failed", "kept")


#: The result of op10 in DuckDB SQL.
ORACLE = """
with d as (
  select doc_id, source, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents
), win as (
  select doc_id, p, (w[p], w[p + 1], w[p + 2]) as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as p from d)
), rep as (
  select doc_id, p from (select *, count(*) over (partition by doc_id, g) as c from win) where c > 1
), cov as (
  select doc_id, count(distinct q)::bigint as n_repeat_words
  from (select doc_id, unnest([p, p + 1, p + 2]) as q from rep) group by doc_id
), m as (
  select d.doc_id, source, len(w)::bigint as n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join cov using (doc_id)
), b as (
  select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m
), f as (
  select *, (base_failed or 10 * n_symbols > n_words or (n_dup_lines >= 3 and 20 * n_dup_lines > n_words)
             or word_chars < 2 * n_words or word_chars > 16 * n_words) as rules_failed from b
), h as (
  select source, count(*) as n, sum(rules_failed::int) as failed from f where source is not null group by source
), fit as (
  select sum(failed)::double / sum(n) as mean, var_pop(failed::double / n) as v, avg(1.0::double / n) as inv from h
), pri as (
  select mean, least(greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, 1e-9) - 1, 1.0), 1e6) as strength from fit
), ver as (
  select source, (failed + mean * strength) / (n + strength) <= 0.5 as host_ok from h, pri
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (not rules_failed and coalesce(host_ok, true)) as kept
from f left join ver using (source)
"""
