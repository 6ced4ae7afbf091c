"""TF-IDF retrieval of short texts within keys, scored by inverted lists inside tasks (IR).

The same scores and order as ``tfidf.cosine_top_k``, without a row for every term
that a query shares with a target.  A record becomes the list of its terms' places
in a vocabulary that was counted before it was broadcast; equal lists are scored
once, and blocks of queries meet blocks of targets in cells of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import io
from .blocking import capped, merged

#: Terms that a vocabulary may have to be broadcast, in all keys together (about 25 bytes each).
VOCABULARY = 2_000_000
#: Distinct lists of a block of queries and of a block of targets, in all keys together.
QUERIES, TARGETS = 100_000, 150_000
#: Where lists are so short that a block has fewer places than this, blocks are longer, up to LONGER times.
PLACES, LONGER = 5_000_000, 4
#: Slices of a block of targets by the length of their vectors, each so many times the one before; queries for which bounds are worked out at once.
SLICES, RATIO, AT_ONCE = 6, 1.3, 2000
#: Postings of a query up to which all are looked up at once.
MANY = 2000
#: What sums may be off by, where a bound is held against a score.
SLACK = 1e-6
#: Blocks of queries, at least, where each has LITTLE lists; a cell takes much time for its bytes.
BLOCKS, LITTLE = 8, 1000


def plain_ids(df: DataFrame, by: str) -> bool:
    """Whether ``by`` has neither nulls nor repeats."""
    return df.groupBy(by).count().where(F.col(by).isNull() | (F.col("count") > 1)).isEmpty()


def _weights(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * idf


def _encoder(shared, top: int | None):
    """Batches of (id, key, terms) to (id, number of the key, places of the terms, with repeats, as int32)."""

    def run(batches):
        for b in batches:
            key, terms = b.column(1).to_pylist(), b.column(2)
            named = {k: i for i, (k, _, _) in enumerate(shared.value)}
            flat, row = terms.flatten(), pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)
            place = np.full(len(flat), -1, np.int64)
            of = np.array([named.get(k, -1) for k in key], np.int32)
            for number, (_, words, _) in enumerate(shared.value):
                at = np.flatnonzero(of[row] == number) if len(row) else row
                if len(at):
                    place[at] = pc.fill_null(pc.index_in(flat.take(pa.array(at)), value_set=words), -1).to_numpy(zero_copy_only=False)
            ok = place >= 0
            row, place = row[ok], place[ok]
            order = np.lexsort((place, row))
            row, place = row[order], place[order]
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            out = []
            for i, number in enumerate(of):
                x = place[ends[i] : ends[i + 1]].astype(np.int32)
                if top is not None and len(x):
                    u, tf = np.unique(x, return_counts=True)
                    best = u[np.argsort(-_weights(tf, shared.value[number][2][u]), kind="stable")[:top]]  # places are in the order of terms
                    x = x[np.isin(x, best)]
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of), pa.array(out, pa.binary())], names=["id", "key", "vec"])

    return run


def _vectors(vecs, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, weight), rows of unit length, and what their lengths were."""
    lists = [np.frombuffer(v, np.int32) for v in vecs]
    row, place = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64)
    both, tf = np.unique(row * len(idf) + place, return_counts=True)
    row, place = both // len(idf), both % len(idf)
    w = _weights(tf, idf[place])
    long = np.sqrt(np.bincount(row, w * w, len(lists)))
    return row, place, w / long[row], long


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.arange(lens.sum()) + np.repeat(starts - np.cumsum(lens) + lens, lens)


class _Block:
    """Targets as rows and as inverted lists; a list is cut into slices of targets of about one length, whose largest weights are kept."""

    def __init__(self, vecs, idf: np.ndarray):
        row, place, self.w, long = _vectors(vecs, idf)
        self.at = np.searchsorted(row, np.arange(len(long) + 1))
        part = np.minimum(np.log(long / long.min()) / np.log(RATIO), SLICES - 1).astype(np.int64)
        code = place * SLICES + part[row]
        order = np.argsort(code, kind="stable")
        self.place, self.rows, self.weights, code = place.astype(np.int32), row[order].astype(np.int32), self.w[order], code[order]
        self.codes, self.starts = np.unique(code, return_index=True)
        self.most = np.maximum.reduceat(self.weights, self.starts)
        self.starts = np.append(self.starts, len(code))

    def lists(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of places begin and end."""
        return tuple(self.starts[np.searchsorted(self.codes, x * SLICES)] for x in (place, place + 1))

    def needed(self, qrow: np.ndarray, qplace: np.ndarray, qw: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
        """(query, begin, end, reach) of the cut lists that hold all targets with scores over ``least``.

        ``reach`` is what a list and the slice's longer ones can add up to together.  Where it is below a
        score, a target that is in none of the shorter lists cannot have that score.
        """
        code = (qplace[:, None] * SLICES + np.arange(SLICES)).ravel()
        i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        there = np.flatnonzero(self.codes[i] == code)
        i, j = i[there], there // SLICES
        group, lens, bound = qrow[j] * SLICES + there % SLICES, self.starts[i + 1] - self.starts[i], qw[j] * self.most[i]
        order = np.lexsort((-lens, group))
        i, group, bound = i[order], group[order], bound[order]
        total = np.cumsum(bound)
        first = np.searchsorted(group, group)
        reach = total - total[first] + bound[first]
        i, group, reach = (x[reach >= least - SLACK] for x in (i, group, reach))
        return group // SLICES, self.starts[i], self.starts[i + 1], reach

    def members(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The targets in any of some lists."""
        x = np.sort(self.rows[_ranges(starts, ends - starts)])
        return x[np.append(True, x[1:] != x[:-1])] if len(x) else x

    def scores(self, to: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Of some targets, for the weights ``asked`` of all places."""
        starts = self.at[to]
        lens = self.at[to + 1] - starts
        x = _ranges(starts, lens)
        return np.round(np.bincount(np.repeat(np.arange(len(to)), lens), asked[self.place[x]] * self.w[x], len(to)), 9)


def _scorer(shared, k: int, least: float):
    """A cell: for each query list the first ``k`` target lists of the block by score, then by least id."""

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[str, np.ndarray, np.ndarray]] = []
        if len(q) and len(t):
            idf = shared.value[q["key"].iloc[0]][2]
            t = t.iloc[np.argsort(t["g"].str.encode("utf-8").to_numpy(), kind="stable")]
            names = t["g"].to_numpy()
            block = _Block(t["vec"], idf)
            mean = len(block.rows) / len(names)
            total, asked, seen = np.zeros(len(names)), np.zeros(len(idf)), np.zeros(len(names), bool)
            for begin in range(0, len(q), AT_ONCE):
                some = q.iloc[begin : begin + AT_ONCE]
                qrow, qplace, qw, _ = _vectors(some["vec"], idf)
                at = np.searchsorted(qrow, np.arange(len(some) + 1))
                starts, ends = block.lists(qplace)
                nrow, nstarts, nends, reach = block.needed(qrow, qplace, qw, least)
                nat = np.searchsorted(nrow, np.arange(len(some) + 1))
                every, few = (np.bincount(x, b - a, len(some)) for x, a, b in ((qrow, starts, ends), (nrow, nstarts, nends)))
                for i, g in enumerate(some["g"]):
                    if not few[i]:
                        continue
                    mine, need = slice(at[i], at[i + 1]), slice(nat[i], nat[i + 1])
                    a, b = nstarts[need], nends[need]
                    asked[qplace[mine]] = qw[mine]
                    to, s = np.zeros(0, np.int64), np.zeros(0)
                    if few[i] > MANY and (short := b - a <= few[i] / 16).any():  # the best of the rare terms' targets may rule out longer lists
                        to = block.members(a[short], b[short])
                        s = block.scores(to, asked)
                        short |= reach[need] < (np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else least) - SLACK
                        a, b = a[~short], b[~short]
                    if (b - a).sum() * mean * 2 < every[i]:  # the targets' own terms are fewer than what is in the lists
                        seen[to] = True
                        more = block.members(a, b)
                        more = more[~seen[more]]
                        seen[to] = False
                        to, s = np.concatenate([to, more]), np.concatenate([s, block.scores(more, asked)])
                    else:
                        hit = []
                        for a, b, v in zip(starts[mine].tolist(), ends[mine].tolist(), qw[mine].tolist(), strict=True):
                            if b > a:
                                total[block.rows[a:b]] += v * block.weights[a:b]
                                hit.append(block.rows[a:b])
                        to = np.flatnonzero(total) if every[i] > len(names) // 8 else np.unique(np.concatenate(hit))
                        s = np.round(total[to], 9)
                        total[to] = 0.0
                    asked[qplace[mine]] = 0.0
                    ok = s > least
                    to, s = to[ok], s[ok]
                    if len(s) > k:
                        ok = s >= np.partition(s, len(s) - k)[len(s) - k]
                        to, s = to[ok], s[ok]
                    best = np.lexsort((to, -s))[:k]
                    if len(best):
                        found.append((g, names[to[best]], s[best]))
        lens = [len(x[1]) for x in found]
        cat = lambda n: np.concatenate([x[n] for x in found]) if found else np.array([])
        return pd.DataFrame({"qg": np.repeat([x[0] for x in found], lens), "tg": cat(1), "score": cat(2)}).astype({"qg": "object", "tg": "object", "score": "float64"})

    return run


def top_k(queries: DataFrame, targets: DataFrame, query_terms, target_terms, idf: DataFrame, keys: list[str], k: int, least: float, top: int | None, left_id: str, right_id: str) -> DataFrame | None:
    """(left, right, score, rank) with the weights of ``idf`` (keys, term, idf); None if the vocabulary is too large to broadcast."""
    spark = queries.sparkSession
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    idf = idf.select(key.alias("key"), "term", "idf")
    idf.write.parquet(path := io.work_path(spark, "vocabulary"))
    idf = spark.read.schema(idf.schema).parquet(path)
    if idf.count() > VOCABULARY:
        return None
    vocabulary = idf.toArrow().sort_by([("key", "ascending"), ("term", "ascending")])  # by bytes
    names, starts = np.unique(vocabulary["key"].to_numpy(zero_copy_only=False).astype(object), return_index=True) if len(vocabulary) else ([], [])
    ends = np.append(starts[1:], len(vocabulary)) if len(starts) else []
    words = [(n, pa.array(vocabulary["term"].slice(a, b - a).to_pylist(), pa.string()), vocabulary["idf"].slice(a, b - a).to_numpy()) for n, a, b in zip(names, starts, ends, strict=True)]
    shared = spark.sparkContext.broadcast(words)

    def encoded(df, name, terms):
        rows = df.where(" and ".join(f"`{c}` is not null" for c in keys) or "true").select(F.col(name).cast("string").alias("id"), key.alias("key"), terms.alias("terms"))
        rows = rows.where("terms is not null").mapInArrow(_encoder(shared, top), "id string, key int, vec binary").where(F.length("vec") > 0)
        rows.write.parquet(to := io.work_path(spark, "places"))
        rows = spark.read.schema(rows.schema).parquet(to)
        return rows, rows.groupBy("key", "vec").agg(F.min("id").alias("g"))

    (q, ql), (t, tl) = encoded(queries, left_id, query_terms), encoded(targets, right_id, target_terms)
    n = ql.count()
    nq = max(1, -(-n // QUERIES), min(BLOCKS, n // LITTLE))
    n, places = tl.agg(F.count("*"), F.coalesce(F.sum(F.length("vec")) / 4, F.lit(0.0))).first()
    nt = max(1, -(-n // (TARGETS * LONGER)), min(-(-n // TARGETS), math.ceil(places / PLACES)))
    cells = 2 * nq * nt * max(1, len(words))
    block = lambda n: F.pmod(F.xxhash64("g"), F.lit(n))
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    ql = ql.select("key", "g", "vec", block(nq).alias("i"), to_all(nt).alias("j"))
    tl = tl.select("key", "g", "vec", to_all(nq).alias("i"), block(nt).alias("j"))
    ql, tl = (x.repartition(cells, "key", "i", "j") for x in (ql, tl))
    cells = ql.groupBy("key", "i", "j").cogroup(tl.groupBy("key", "i", "j")).applyInPandas(_scorer(shared, k, least), "qg string, tg string, score double")
    # The first k lists by score, then by least id, hold the first k targets.
    lists = cells.withColumn("rn", F.row_number().over(Window.partitionBy("qg").orderBy(F.desc("score"), "tg"))).where(F.col("rn") <= k).drop("rn")
    lists.write.parquet(path := io.work_path(spark, "lists"))
    lists = spark.read.schema(lists.schema).parquet(path)
    members = lambda rows: merged(rows, rows.groupBy("key", "vec").agg(F.min("id").alias("g")), ["key", "vec"])
    first = capped(members(t).select(F.col("g").alias("tg"), F.col("id").alias(right_id)), ["tg"], right_id, k)
    pairs = merged(lists, first, ["tg"]).withColumn("rank", F.row_number().over(Window.partitionBy("qg").orderBy(F.desc("score"), right_id))).where(F.col("rank") <= k)
    return merged(members(q).select(F.col("g").alias("qg"), F.col("id").alias(left_id)), pairs, ["qg"]).select(left_id, right_id, "score", "rank")
