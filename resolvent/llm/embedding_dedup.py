"""Operator 1: near-duplicate embeddings by iterative quantisation.

Rotations learned on a bounded sample turn vectors into balanced 64-bit codes
(one rotation, or several where vectors have fewer than 64 dimensions).  The code's four 16-bit chunks index multi-index Hamming tables: every
vector is stored under its own chunks and asks for all chunks that differ in at
most one bit, so a pair is missed only if each chunk differs in two bits or
more.  Candidates within a Hamming radius are reranked with the original
vectors in double precision.  A pair that meets in several tables is produced by
the first of them only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._scratch import Scratch
from ._skew import HOT, join_unique

#: Vectors that the rotation is learned from, at most; chosen by a hash of the vector.
SAMPLE = 20_000
CHUNKS, WIDTH = 4, 16
#: Codes of two vectors at the threshold differ in about 8 bits (standard deviation 2.6).
RADIUS = 20


def learn_code(x: np.ndarray, bits: int = CHUNKS * WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) to ``bits`` signs, from as many rotations as that takes."""
    learned = [learn_rotation(x, bits, seed=5 + i) for i in range(-(-bits // x.shape[1]))]
    return learned[0][0], np.concatenate([p for _, p in learned], axis=1)[:, :bits]


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal axes turned so that signs lose least (iterative quantisation)."""
    mean = x.mean(axis=0)
    c = x - mean
    _, axes = np.linalg.eigh(c.T @ c / max(1, len(c)))
    axes = axes[:, ::-1][:, :bits]
    v = c @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1], axes.shape[1])))
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    return mean, axes @ r


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _encode(model):
    """Adds the code: bit i is the sign of the i-th rotated coordinate; other lengths than the model's get signs of fixed random directions."""
    schema = pa.schema([("g", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("code", pa.int64())])

    def run(batches):
        mean, proj = model.value
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            code = np.zeros(batch.num_rows, np.uint64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _matrix(batch.column(3).take(pa.array(at)), int(d))
                v = (x - mean) @ proj if d == len(mean) else x @ np.random.default_rng(int(d)).standard_normal((int(d), CHUNKS * WIDTH))
                signs = (v >= 0).astype(np.uint64)
                code[at] = (signs << np.arange(signs.shape[1], dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(code.view(np.int64))], schema=schema)

    return run


def _reranked(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            cos = np.full(batch.num_rows, -2.0)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x, y = (_matrix(batch.column(i).take(pa.array(at)), int(d)) for i in (3, 4))
                cos[at] = (x * y).sum(axis=1)
            ok = pa.array(cos >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(cos).filter(ok)], schema=schema)

    return run


def _code_distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _chunk(c, t: int):
    return F.shiftrightunsigned(c, WIDTH * t).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _meetings(codes: DataFrame) -> DataFrame:
    """(ga, ca, gb, cb, t) for every chunk ``t`` of a code that differs from another's in at most one bit.

    Both sides are merged: Spark estimates them by the size of the codes' files, before a code
    becomes 4 rows and 68, and would broadcast either.
    """
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _chunk(F.col("code"), t).alias("chunk")) for t in range(CHUNKS)])).alias("x")
    stored = codes.select("g", "label", "dim", "code", table).select("g", "label", "dim", "code", "x.*")
    near = F.explode(F.array(F.lit(0), *[F.lit(1 << i) for i in range(WIDTH)])).alias("flip")
    asked = stored.select(F.col("g").alias("ga"), "label", "dim", F.col("code").alias("ca"), "t", F.col("chunk"), near).withColumn("chunk", F.col("chunk").bitwiseXOR(F.col("flip").cast("long"))).drop("flip")
    return asked.hint("merge").join(stored.select(F.col("g").alias("gb"), "label", "dim", F.col("code").alias("cb"), "t", "chunk"), ["label", "dim", "t", "chunk"])


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, sample: int = SAMPLE, radius: int = RADIUS) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of ``vectors``.

    Rows with equal labels and lengths link if their cosine is at least
    ``threshold``.  A vector that is null, empty, all zero or holds null or
    non-finite components, and one without a label, links with nothing and is
    its own component.  Rows are vectors of their own even where ids or vectors
    repeat: equal vectors link.  A null id counts as a vector but names no
    component.  Other columns are not read; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = F.col("label").isNotNull() & F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    name = [F.col("label"), F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    good = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # Equal vectors of a label are one vertex with a weight.
    groups = good.where("fine").select("id", "v", *name).groupBy("label", "dim", "h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("w"), F.min("v").alias("v"))
    groups = scratch.cut(groups.withColumn("g", F.monotonically_increasing_id()), "groups")

    dims = [r["dim"] for r in groups.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()]
    if not dims:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    fit = groups.where(F.col("dim") == dims[0]).orderBy("h1", "h2", "g").limit(sample).select("v").toArrow()  # the documented bound of the fit
    model = spark.sparkContext.broadcast(learn_code(_matrix(fit.column("v").combine_chunks(), dims[0])))
    codes = scratch.cut(groups.select("g", "label", "dim", "v").mapInArrow(_encode(model), "g long, label string, dim int, code long"), "codes")

    met = _meetings(codes)
    other = [(F.col("t") <= t) | (F.bit_count(_chunk(F.col("ca").bitwiseXOR(F.col("cb")), t)) > 1) for t in range(CHUNKS - 1)]
    first = other[0]
    for x in other[1:]:
        first = first & x
    pairs = met.where((F.col("ga") < F.col("gb")) & (_code_distance("ca", "cb") <= radius) & first).select("ga", "gb")

    side = groups.select("g", "dim", "v", "w")
    both = pairs.join(side.select(F.col("g").alias("ga"), "dim", F.col("v").alias("va")), "ga").join(side.select(F.col("g").alias("gb"), F.col("v").alias("vb")), "gb")
    links = scratch.cut(both.select("ga", "gb", "dim", "va", "vb").mapInArrow(_reranked(threshold), "a long, b long, cosine double").select("a", "b"), "links")
    comp = components(spark, links, scratch)

    weights = side.select("g", "w")
    count = links.union(links.select("b", "a")).join(weights.withColumnRenamed("g", "b"), "b").groupBy(F.col("a").alias("g")).agg(F.sum("w").alias("met"))
    named = groups.select("g", "label", "dim", "h1", "h2", "least", "w").join(comp.withColumnRenamed("id", "g"), "g", "left").withColumn("root", F.coalesce("component", "g"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").join(count, "g", "left").select("label", "dim", "h1", "h2", "component_id", (F.col("w") - 1 + F.coalesce("met", F.lit(0))).alias("links"))
    # Vectors with very many copies (fewer than HOT) are answered by a broadcast; those that link with nothing meet none.
    keys = ["label", "dim", "h1", "h2"]
    hot = groups.where(F.col("w") > rows.count() // HOT).select(*keys)
    out = join_unique(good.where("fine").select("id", *name), named, keys, "left", hot).select("id", "links", "component_id")
    out = out.unionByName(good.where("not fine").select("id", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component_id")))
    root = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(False)).alias("kept"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The result of op1 in DuckDB SQL: all pairs of a label, then components by passing the smallest id along.
ORACLE = """
with recursive e as (
  select vec_id, label, embedding::double[] as v from embeddings
), ok as (
  select * from e where label is not null and v is not null and len(v) > 0
    and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), p as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93
), r(id, root) as (
  select vec_id, vec_id from e
  union
  select p.b, r.root from r join p on p.a = r.id where r.root < p.b
), c as (
  select id, min(root) as component_id from r group by id
), n as (
  select a, count(*) as n from p group by a
)
select vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from e join c on c.id = e.vec_id left join n on n.a = e.vec_id
"""
