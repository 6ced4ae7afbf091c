"""Operator 6: mixing sources to target weights by Efraimidis-Spirakis sampling.

DataFrame operations only.  Every document has a key ``-ln(u) / w`` with u a
hash of its id and w its quality weight; within its source documents stand in
ascending order of keys and a prefix sum of sizes is held against the source's
budget of words.  Complete epochs (every document once) come before that
fractional selection.

The prefix sum does not sort a source in one task: keys fall into ranges whose
number follows the source's number of documents, sums of ranges are added up
first, and only the documents of one range are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._scratch import Scratch
from .packing import n_words

#: Documents that a range of keys has on average.
RANGE = 2048
#: Rows of a table per source, or per range, up to which it is broadcast.
BROADCAST_ROWS = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): budgets in words.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all words.  A target stops at ``most`` times its source's size
    and the excess is shared again by weight.  That water level is found without
    iterating: sources that stop are those with the smallest size per weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    x = x.withColumn("per", F.col("cap") / F.col("w"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up = Window.orderBy("per", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(every))
    x = x.withColumn("caps", F.sum("cap").over(up)).withColumn("ws", F.sum("w").over(up))
    # The level if this source and all later ones are under their caps; it stops where the level reaches its cap.
    level = (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("all_w") - (F.col("ws") - F.col("w")))
    x = x.withColumn("level", level).withColumn("stops", F.col("level") >= F.col("per"))
    least = F.min(F.when(~F.col("stops"), F.struct("per", F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return x.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(least * F.col("w")).alias("target"))


def uniform(c: Column) -> Column:
    """A number in (0, 1) from the MD5 of a column's text: 52 bits, the same in any engine."""
    return (F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (words, repeats counted).

    ``copies`` is how often the mix takes the document: the source's complete
    epochs, and once more where the middle of its words in the prefix sum lies
    within the rest of the budget, so a source misses its target by half a
    document at most.  A null text has size 0; null sources are one source; a
    null id is drawn like the empty text; ``weight_col`` that is null or not
    positive counts as 1.  Rows of one id stand side by side and are told apart
    by the hash of their text; equal rows are taken alike.  Columns of ``docs``
    named like the new ones are replaced; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    new = ("size", "source_size", "target", "copies", "taken")
    weight = F.lit(1.0) if weight_col is None else F.col(f"`{weight_col}`").cast("double")
    weight = F.when(weight > 0, weight).otherwise(1.0)
    key, who, h = -F.log(uniform(F.col(id_col))) / weight, F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(F.col(text_col))
    source = F.col(source_col).cast("string")

    slim = scratch.cut(docs.select(source.alias("src"), n_words(text_col).alias("size"), F.struct(key.alias("key"), who.alias("id"), h.alias("h")).alias("at")), "sizes")
    per_source = slim.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), F.avg("at.key").alias("mean"))
    goal = targets(per_source.select(F.col("src").alias("source"), "source_size"), weights, share, most)
    plan = goal.join(per_source.drop("source_size"), F.col("source").eqNullSafe(F.col("src"))).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = scratch.cut(plan.withColumn("ranges", F.ceil(F.col("docs") / F.lit(float(RANGE))).cast("long")), "plan")

    # Keys are about exponential: their distribution function deals them evenly over the ranges.
    part = F.floor((1 - F.exp(-F.col("at.key") / F.greatest("mean", F.lit(1e-300)))) * F.col("ranges")).cast("long")
    drawn = slim.alias("s").join(_small(plan).alias("p"), F.col("s.src").eqNullSafe(F.col("p.src"))).select("p.*", "size", "at", part.alias("part"))
    sums = drawn.groupBy("src", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.cut(sums.select(F.col("src").alias("src2"), F.col("part").alias("part2"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead")), "ranges")
    # Only the range in which a budget ends needs an order of its documents.
    inside = Window.partitionBy("src", "part").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = drawn.join(_small(sums), F.col("src").eqNullSafe(F.col("src2")) & (F.col("part") == F.col("part2")))
    upto = F.col("ahead") + F.sum("size").over(inside)
    chosen = ends.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2.0 <= F.col("rest"))
    last = chosen.groupBy(F.col("src").alias("src2")).agg(F.max("at").alias("last"))
    final = scratch.cut(plan.join(last, F.col("src").eqNullSafe(F.col("src2")), "left").select(F.col("src").alias("__src"), "source_size", "target", "epochs", "last"), "cutoffs")

    keep = [c for c in docs.columns if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], source.alias("__s"), n_words(text_col).alias("size"), F.struct(key.alias("key"), who.alias("id"), h.alias("h")).alias("__at"))
    rows = rows.join(_small(final), F.col("__s").eqNullSafe(F.col("__src")))
    copies = F.col("epochs") + F.coalesce(F.col("__at") <= F.col("last"), F.lit(False)).cast("long")
    return rows.withColumn("copies", copies).select(*[F.col(f"`{c}`") for c in keep], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _small(table: DataFrame) -> DataFrame:
    """A written table that is broadcast if its number of rows is small; else the join shuffles."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def quality_weight(text_col: str) -> Column:
    """A document's quality weight: 0.5 for fewer than 50 words or over one stray symbol per 20 words, else 2."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words, symbols = n_words(text_col), F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    return F.when((words < 50) | (20 * symbols > words), 0.5).otherwise(2.0)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix_sources(docs.withColumn("weight", quality_weight("text")), weight_col="weight")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The result of op6 in DuckDB SQL.
ORACLE = """
with m as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) as symbols
  from documents
), d as (
  select doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double)
           / case when size < 50 or 20 * symbols > size then 0.5::double else 2.0::double end as k
  from m
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select source, source_size, source_size::double * 2.0::double as cap,
         ([5.0, 2.0, 1.0]::double[])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w
  from s
), p as (
  select *, cap / w as per, (sum(source_size) over ())::double * 1.5::double as total, sum(w) over () as all_w from w
), q as (
  select *, sum(cap) over (order by per, source nulls last rows unbounded preceding) as caps,
         sum(w) over (order by per, source nulls last rows unbounded preceding) as ws from p
), l as (
  select *, (total - (caps - cap)) / (all_w - (ws - w)) as level from q
), t as (
  select source, source_size,
         case when level >= per then cap
              else (select m.level from l m where not m.level >= m.per order by m.per, m.source nulls last limit 1) * w end as target
  from l
), e as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t
), r as (
  select d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
         sum(d.size) over (partition by d.source order by d.k, d.doc_id range unbounded preceding) as upto
  from d join e on d.source is not distinct from e.source
)
select doc_id, size, source_size, target,
       (size * (epochs + case when upto - size / 2.0::double <= rest then 1 else 0 end))::bigint as taken
from r
"""
