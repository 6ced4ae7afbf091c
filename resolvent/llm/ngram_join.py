"""Operator 3: n-gram Jaccard self-join by a size-aware heavy-light plan.

Two documents link when the Jaccard similarity of their sets of 5-word shingles
is at least 0.75; the test is exact (integers only).  Sets are ordered by one
global order of shingles: shingles seen often come last, the rest go by hash.
Any order gives exact results; this one keeps inverted lists short.

* A light set (size up to a boundary) enumerates all 2-subsets of its extended
  prefix; two light sets that link share one of them.
* A heavy set is looked up in inverted lists of its prefix shingles; a pair
  with a heavy set shares enough of them for a counting bound.
* Candidates whose marks (parities of hashed members, a few bits a member)
  differ in more places than a link allows are dropped before whole sets are
  sent; no linking pair is.
* The boundary is the size up to which the subsets cost fewer rows than the
  lists, from the histogram of the sizes (up to 256, beyond which subsets never
  pay) and the mean list length.

Equal sets are one vertex, named by a 128-bit digest.  Long lists are first
contracted around their member with the fewest shingles of its own, so a large
group of near copies makes a star and not all its pairs; the pairs that are
left across components are then all tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _vec as V
from ._graph import components
from ._scratch import Scratch
from ._skew import frequent, join_unique

#: Shingles whose place in the order reflects their count; more would only save time.
FREQUENT = 1 << 16
#: A list of more sets is contracted around one member before its pairs are made.
LONG_LIST = 24
#: Rows of lists that a pair of sets to be tested costs as much as.
PAIR_COST = 16
_BITS = 1 << 23


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (numpy's own ``unique`` hashes, which is slower)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]]


def _shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, sorted distinct shingle hashes) for every row; None where it has no word."""
    for first, raw, offsets in V.chunks(texts):
        raw = V.lower_ascii(raw)
        s, e, r = V.cut_words(raw, offsets)
        g, gr = V.grams(V.span_hash(raw, s, e), r, k)
        at = np.searchsorted(gr, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            yield first + i, (distinct(g[at[i] : at[i + 1]]) if at[i] < at[i + 1] else None)


_C = V.stream(4, 77) | np.uint64(1)


def _digest(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; two independent sums of mixed members."""
    with np.errstate(over="ignore"):
        a = V.mix(np.array([V.mix(x * _C[0]).sum() + np.uint64(len(x))], np.uint64))
        b = V.mix(np.array([V.mix(x * _C[1] + _C[2]).sum()], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _marks(x: np.ndarray) -> bytes:
    """Parities of the members by hash, in as many bits as the next power of two above their number (64 at least).

    Marks of two sets differ in no more places than the sets have members apart.
    """
    size = max(64, 1 << (len(x) - 1).bit_length())
    odd = np.bincount((V.mix(x) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """Places in which marks differ, the longer ones folded to the length of the shorter."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


_PROFILE = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n", "d1", "d2", "token", "count")] + [T.StructField("marks", T.BinaryType())])


def _profile(k: int):
    """A row (doc_id, n, d1, d2, marks) per document and a row (token, count) per shingle in several sets of the task."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        size = 0

        def repeated():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c > 1], c[c > 1]
            none = pa.nulls(len(u), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(V.signed(u)), pa.array(c.astype(np.int64)), pa.nulls(len(u), pa.binary())], schema=schema)

        schema = pa.schema([(n, pa.binary() if n == "marks" else pa.int64()) for n in _PROFILE.names])
        for batch in batches:
            n, d1, d2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            marks: list[bytes | None] = [None] * batch.num_rows
            for i, x in _shingle_sets(batch.column(1), k):
                if x is None:
                    continue
                n[i] = len(x)
                marks[i] = _marks(x)
                d1[i], d2[i] = d = _digest(x)
                if d not in seen:
                    if len(seen) < 50_000:
                        seen.add(d)
                    held.append(x)
                    size += len(x)
                    if size > 1_500_000:
                        yield repeated()
                        size = 0
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(d1), pa.array(d2), none, none, pa.array(marks, pa.binary())], schema=schema)
        if held:
            yield repeated()

    return run


def _prefix(n: int, k: int = 1) -> int:
    """Members of a set of n of which k at least are shared with each set that links (75 %)."""
    return n - (3 * n + 3) // 4 + k


_ROWS = "key long, kind int, d1 long, d2 long, n int, w int"


def _list_rows(k: int, frequent: np.ndarray, place: np.ndarray, light: int):
    """Rows of the inverted lists: kind 1 for prefix shingles, kind 2 for 2-subsets of light sets."""
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int32()), ("w", pa.int32())])
    least_heavy = (3 * (light + 1) + 3) // 4  # the smallest set that may link with a heavy one

    def run(batches):
        seen: set[tuple[int, int]] = set()
        out: list[tuple[np.ndarray, int, tuple[int, int], int]] = []
        held = 0

        def flush():
            sizes = [len(x[0]) for x in out]
            col = lambda f, t: np.repeat(np.array([f(x) for x in out], t), sizes)
            got = pa.RecordBatch.from_arrays(
                [pa.array(V.signed(np.concatenate([x[0] for x in out]))), pa.array(col(lambda x: x[1], np.int32)), pa.array(col(lambda x: x[2][0], np.int64)), pa.array(col(lambda x: x[2][1], np.int64)), pa.array(col(lambda x: x[3], np.int32)), pa.array(np.concatenate([np.arange(1, m + 1) if x[1] == 1 else np.zeros(m) for x, m in zip(out, sizes, strict=True)]).astype(np.int32))],
                schema=schema,
            )
            out.clear()
            return got

        for batch in batches:
            for _, x in _shingle_sets(batch.column(0), k):
                if x is None:
                    continue
                d = _digest(x)
                if d in seen:
                    continue
                if len(seen) < 50_000:
                    seen.add(d)
                n = len(x)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
                    rank = np.where(frequent[at] == x, place[at], 0)
                    if rank.any():
                        x = x[np.argsort(rank, kind="stable")]
                if n <= light:
                    p = x[: _prefix(n, 2)]
                    i, j = np.triu_indices(len(p), 1)
                    out.append((V.mix(p[i] * _C[0] + p[j] * _C[3]), 2, d, n))
                    held += len(i)
                if n >= least_heavy:
                    out.append((x[: _prefix(n)], 1, d, n))
                    held += _prefix(n)
                if held > 200_000:
                    yield flush()
                    held = 0
        if out:
            yield flush()

    return run


def _boundary(sizes: list[tuple[int, int]], mean_list: float) -> int:
    """The size up to which 2-subsets cost fewer rows than lists whose rows meet ``mean_list`` others."""
    best, spare = 0, 0.0
    for n, count in sorted(sizes):
        if n < 3:
            continue
        p = _prefix(n, 2)
        spare += count * (_prefix(n) * (1 + mean_list) - p * (p - 1) / 2)
        if spare >= 0:
            best = n
        elif n > 64:
            break
    return best


def _bitmap(ids: DataFrame, col: str) -> np.ndarray:
    """A Bloom filter of one hash and fixed size (1 MB) over a column of longs."""
    b = F.pmod(F.xxhash64(F.col(col)), F.lit(_BITS))
    words = ids.select(F.shiftright(b, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(31)).cast("int")).alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    out = np.zeros(_BITS >> 5, np.uint32)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy(zero_copy_only=False)] = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
    return out


def maybe(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, a1, b, b1) whose marks (of ``sets``: id, d1, n, marks) do not already differ too much for a link; none that links is lost."""

    def near(batches):
        for batch in batches:
            cols = (batch.column(i) for i in range(4, 8))
            ok = []
            for n, x, m, y in zip(*cols, strict=True):
                n, x, y = n.as_py() + m.as_py(), *(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                ok.append(_apart(x, y) <= n - 2 * ((3 * n + 6) // 7))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(ok, pa.bool_()))

    told = sets.select("id", "d1", "n", "marks")
    both = pairs.join(told.toDF("a", "a1", "na", "ma"), ["a", "a1"]).join(told.toDF("b", "b1", "nb", "mb"), ["b", "b1"])
    return both.select("a", "a1", "b", "b1", "na", "ma", "nb", "mb").mapInArrow(near, "a long, a1 long, b long, b1 long")


def verify(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Pairs (a, a1, b, b1: document ids and digests) whose sets link, tested on the whole sets.

    Only documents that a bitmap of fixed size lets through send their sets.
    """
    need = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(need, "id"))
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("members", pa.binary())])

    def sets(batches):
        have = bits.value
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(((have[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)))
            ids, hs, ms = [], [], []
            held = 0
            for i, x in _shingle_sets(batch.column(1), k):
                if x is not None:
                    ids.append(batch.column(0)[i].as_py())
                    hs.append(_digest(x)[0])
                    ms.append(x.tobytes())
                    held += x.nbytes
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(ms, pa.binary())], schema=schema)
                        ids, hs, ms, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(ms, pa.binary())], schema=schema)

    chosen = docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(_BITS)).alias("at"))
    chosen = chosen.mapInArrow(sets, "id long, h long, members binary")
    left = pairs.join(chosen.toDF("a", "a1", "ma"), ["a", "a1"]).join(chosen.toDF("b", "b1", "mb"), ["b", "b1"])

    def tested(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return left.select("a", "b", "ma", "mb").mapInArrow(tested, "a long, b long")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id that links reach.  A null text is empty;
    a row without words has an empty set and is its own component.  Rows of one
    id are one vertex; a null id links through equal or similar text like any
    other and takes the smallest id of its component (null if there is none).
    Repeated rows give repeated results; a text of any length is one set.  Other
    columns, of whatever name, are not read.  An empty table gives an empty
    table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    told = scratch.cut(docs.mapInArrow(_profile(k), _PROFILE), "profile")
    profile = told.where("token is null").select(F.col("doc_id").alias("id"), "n", "d1", "d2", "marks")
    counts = told.where("token is not null").groupBy("token").agg(F.sum("count").alias("count"))
    # FREQUENT rows at most: they only order the shingles.
    common = sorted((-r["count"], r["token"]) for r in counts.where("count >= 4").orderBy(F.desc("count"), "token").limit(FREQUENT).collect())
    tokens = np.array([t for _, t in common], np.int64).view(np.uint64)
    place = np.arange(len(tokens), 0, -1)
    order = np.argsort(tokens)
    tokens, place = tokens[order], place[order]
    sizes = [(r["n"], r["count"]) for r in profile.where("n between 1 and 256").groupBy("n").count().collect()]
    totals = profile.agg(F.sum("n").alias("n")).first()["n"] or 1
    # Frequent shingles stand last and are hardly ever in a prefix: the others make the lists.
    rare = counts.where(F.col("count") < F.lit(-common[-1][0] if len(common) == FREQUENT else 4))
    meets = rare.agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
    light = _boundary(sizes, PAIR_COST * meets / totals)
    hot = spark.sparkContext.broadcast((tokens, place))

    def rows(batches, k=k, light=light):
        yield from _list_rows(k, *hot.value, light)(batches)

    one = Window.partitionBy("key")
    node = F.struct("d1", "d2")
    lists = docs.select("text").mapInArrow(rows, _ROWS)
    lists = lists.withColumn("lo", F.min(node).over(one)).withColumn("hi", F.max(node).over(one)).where("lo <> hi")
    # The vertex of a set is the smallest id of its documents.
    sole = profile.where("n > 0").groupBy("d1", "d2", "n", "marks").agg(F.min("id").alias("id")).where("id is not null")
    sole = scratch.cut(sole, "sets")
    live = lists.select("key", "kind", "d1", "d2", "n", "w").distinct().join(sole.select("id", "d1", "d2"), ["d1", "d2"])
    live = scratch.cut(live.select("key", "kind", "id", "d1", "n", "w"), "lists")

    # Prefix members in no other prefix only choose the middle of a star: they may stand behind the prefix of a larger set.
    shared = live.where("kind = 1").groupBy("id", "d1").agg(F.count("*").alias("shared"))
    floor = F.expr("(3 * n + 3) div 4")
    own = F.col("n") - floor + 1 - F.coalesce("shared", F.lit(0))
    members = live.join(shared, ["id", "d1"], "left").withColumn("own", F.when(F.col("kind") == 1, own).otherwise(0))

    w = Window.partitionBy("key", "kind")
    long_lists = members.withColumn("len", F.count("*").over(w)).where(F.col("len") > LONG_LIST)
    best = F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "id", "d1", "n")).over(w)
    star = long_lists.withColumn("c", best).where("(c.id <> id or c.d1 <> d1) and 4 * c.n >= 3 * n and 4 * n >= 3 * c.n")
    star = star.select(F.col("c.id").alias("a"), F.col("c.d1").alias("a1"), F.col("id").alias("b"), F.col("d1").alias("b1")).distinct()
    star = scratch.cut(maybe(star, sole), "star")
    first = scratch.cut(verify(docs, star, k), "links")
    groups = components(spark, first, scratch).select("id", F.col("component").alias("comp"))
    groups = scratch.cut(groups, "groups")

    side = members.join(groups, "id", "left").withColumn("comp", F.coalesce("comp", "id")).select("key", "kind", "id", "d1", "n", "w", "comp")
    x, y = side.alias("x"), side.alias("y")
    # Sets that link share a member among the first n - overlap + 1 of both, overlap the least that a link of these sizes has.
    overlap = F.expr("(3 * (x.n + y.n) + 6) div 7")
    meet = (
        (F.col("x.key") == F.col("y.key")) & (F.col("x.kind") == F.col("y.kind")) & (F.col("x.comp") < F.col("y.comp"))
        & (4 * F.col("x.n") >= 3 * F.col("y.n")) & (4 * F.col("y.n") >= 3 * F.col("x.n"))
        & ((F.col("x.kind") == 2) | (((F.col("x.n") > light) | (F.col("y.n") > light)) & (F.col("x.w") <= F.col("x.n") - overlap + 1) & (F.col("y.w") <= F.col("y.n") - overlap + 1)))
    )
    names = [F.col(f"{s}.{c}").alias(f"{t}{i}") for s, t in (("x", "a"), ("y", "b")) for c, i in (("id", ""), ("d1", "1"))]
    pairs = x.join(y, meet).select(*names)
    pairs = scratch.cut(maybe(pairs.distinct(), sole), "pairs")
    second = scratch.cut(verify(docs, pairs, k), "links")
    final = components(spark, first.union(second), scratch)
    final = scratch.cut(final, "components")

    classes = sole.join(final, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component_id"))
    # Sets with many copies are answered by a broadcast; a document without words meets none.
    full = profile.where("n > 0").drop("marks")
    out = join_unique(full, classes, ["d1", "d2"], "left", frequent(full, ["d1", "d2"], scratch)).select("id", "n", "component_id")
    out = out.unionByName(profile.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The result of op3 in DuckDB SQL: all shared shingles counted, then the smallest id passed along the links.
ORACLE = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)
), n as (
  select doc_id, count(*) as n from s group by 1
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)
), r(id, root) as (
  select doc_id, doc_id from documents
  union
  select l.b, r.root from r join l on l.a = r.id where r.root < l.b
), m as (
  select id, min(root) as component_id from r group by 1
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id
from documents d join m on m.id = d.doc_id left join n on n.doc_id = d.doc_id
"""
