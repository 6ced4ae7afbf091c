"""TF-IDF retrieval for few queries over many long texts, scored inside tasks (IR).

The same scores and order as ``tfidf.cosine_top_k`` without a row for every term of a
text.  One pass counts the texts of each term, by sorting numbers inside tasks; the
counts are broadcast, and a second pass has each text's length and its products with
all queries.  A task keeps the first k texts of a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import io

#: Queries and their terms, at most.
FEW, TERMS = 5000, 300_000
#: Terms of two texts or more that may be broadcast, as words (about 25 bytes each) and as numbers (12 bytes).
WORDS, NUMBERS = 4_000_000, 10_000_000
#: Slices of texts whose words are looked up together, since a lookup reads the whole vocabulary.
TOGETHER = 8
#: Characters of texts that are taken at once, cells of a matrix of texts and queries, counts kept by a task.
CHARACTERS, CELLS, COUNTS = 2_000_000, 2_000_000, 2_000_000
#: Characters of normalised texts, by number; 0 is none.
ALPHABET = b"\0 _0123456789abcdefghijklmnopqrstuvwxyz"
#: Characters of a gram that fit into a number, at most.
LONGEST = 5

_NUMBER = np.zeros(256, np.int32)
_NUMBER[list(ALPHABET)] = np.arange(len(ALPHABET))


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.arange(lens.sum()) + np.repeat(starts - np.cumsum(lens) + lens, lens)


def _slices(text: pa.Array, rows: int):
    """(begin, length) of runs of texts with CHARACTERS in all and at most ``rows``, or of one text."""
    ends, begin = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)), 0
    while begin < len(text):
        before = ends[begin - 1] if begin else 0
        end = min(max(begin + 1, int(np.searchsorted(ends, before + CHARACTERS, "right"))), begin + rows)
        yield begin, end - begin
        begin = end


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, place in the terms, times) and the distinct terms."""
    parts = pc.split_pattern(text, " ")
    flat, row = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    ok = pc.fill_null(pc.greater(pc.binary_length(flat), 0), False)
    flat, row = flat.filter(ok).dictionary_encode(), row[ok.to_numpy(zero_copy_only=False)]
    n = max(1, len(text))
    both, tf = np.unique(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + row, return_counts=True)
    return both % n, both // n, tf, flat.dictionary


def _grams(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """As ``_words``, terms being numbers of n characters (a shorter text is one term); None if there are other characters."""
    text = pc.fill_null(text, "")
    lens = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    x = _NUMBER[np.frombuffer("".join(text.to_pylist()).encode("utf-8"), np.uint8)]
    if not x.all():
        return None
    starts, many = np.cumsum(lens) - lens, np.where(lens > 0, np.maximum(lens - n + 1, 1), 0)
    code = np.zeros(len(x), np.int64)
    for j in range(n):
        code *= 64
        code[: len(x) - j] += x[j:]
    for i in np.flatnonzero((lens > 0) & (lens < n)):
        code[starts[i]] = int(sum(int(c) << 6 * (n - 1 - j) for j, c in enumerate(x[starts[i] : starts[i] + lens[i]])))
    bits = max(1, len(lens).bit_length())
    both = np.sort(code[_ranges(starts, many)] << bits | np.repeat(np.arange(len(lens)), many))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    code = both >> bits
    new = np.append(True, code[1:] != code[:-1]) if len(code) else np.zeros(0, bool)
    return both & ((1 << bits) - 1), np.cumsum(new) - 1, np.ones(len(both), np.int64), code[new]


def _terms(text: pa.Array, n: int | None):
    return _words(text) if n is None else _grams(text, n)


def _counter(n: int | None):
    """Batches of texts to (term, texts) by task; a term that is null if a text cannot be read as numbers."""
    kind = pa.string() if n is None else pa.int64()

    def summed(terms: list, counts: list):
        t = pa.table({"term": pa.chunked_array([pa.array(x, kind) for x in terms], kind), "df": pa.chunked_array([pa.array(x, pa.int64()) for x in counts], pa.int64())})
        if n is None:
            t = t.group_by("term").aggregate([("df", "sum")]).rename_columns(["term", "df"])
            return t["term"].combine_chunks(), t["df"].to_numpy()
        term, df = t["term"].to_numpy(), t["df"].to_numpy()
        order = np.argsort(term, kind="stable")
        term, df = term[order], df[order]
        at = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        return term[at], np.add.reduceat(df, at)

    def out(term, df):
        yield from pa.table({"term": pa.array(term, kind), "df": pa.array(df, pa.int64())}).to_batches(100_000)

    def run(batches):
        terms, counts, held = [], [], 0
        for b in batches:
            for begin, many in _slices(b.column(0), 10**9):
                if (x := _terms(b.column(0).slice(begin, many), n)) is None:
                    yield from out([None], [1])
                    return
                terms.append(x[3])
                counts.append(np.bincount(x[1], minlength=len(x[3])))
                held += len(x[3])
                if held > COUNTS:
                    a, c = summed(terms, counts)
                    terms, counts, held = [a], [c], len(a)
                    if held > COUNTS // 2:
                        yield from out(a, c)
                        terms, counts, held = [], [], 0
        if held:
            yield from out(*summed(terms, counts))

    return run


def _places(terms, of) -> np.ndarray:
    """Where terms are in ``of``, which is sorted if it has numbers; -1 where they are not."""
    if isinstance(of, pa.Array):
        return pc.fill_null(pc.index_in(terms, value_set=of), -1).to_numpy(zero_copy_only=False)
    if not len(of):
        return np.full(len(terms), -1)
    i = np.minimum(np.searchsorted(of, terms.astype(of.dtype)), len(of) - 1)
    return np.where(of[i] == terms, i, -1)


def _first(q: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows that are the first k of their query by score, then by id."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -s, q))
    at = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - at < k]


def _scorer(shared, n: int | None, k: int, least: float, types: tuple[pa.DataType, pa.DataType]):
    """Batches of (id, text) to (query, id, score): the first k of a task's texts by query."""

    def looked_up(x, text):
        cuts = list(_slices(text, max(1, CELLS // len(x["ids"]))))
        for c in range(0, len(cuts), step := TOGETHER if n is None else 1):
            parts = [_terms(text.slice(*cut), n) for cut in cuts[c : c + step]]
            terms = pa.concat_arrays([p[3] for p in parts]) if n is None else parts[0][3]
            i, asked = _places(terms, x["terms"]), _places(terms, x["asked"])
            at = np.cumsum([0, *(len(p[3]) for p in parts)])
            for (begin, rows), p, a, e in zip(cuts[c : c + step], parts, at, at[1:], strict=False):
                yield begin, rows, p, i[a:e], asked[a:e]

    def run(batches):
        x = shared.value
        many = len(x["ids"])
        q, s, ids, kth = np.zeros(0, np.int64), np.zeros(0), None, np.zeros(many)
        for b in batches:
            own = np.array([v.encode("utf-8") for v in b.column(0).to_pylist()], object) if pa.types.is_string(b.column(0).type) else b.column(0).to_numpy(zero_copy_only=False)
            for begin, rows, (row, place, tf, terms), i, asked in looked_up(x, b.column(1)):
                idf = np.where(i >= 0, x["idf"][i], x["once"]) if len(x["idf"]) else np.full(len(terms), x["once"])
                w = (1 + np.log(tf)) * idf[place]
                long = np.sqrt(np.bincount(row, w * w, rows))
                asked = asked[place]
                ok = np.flatnonzero((asked >= 0) & (w > 0))
                row, w, asked = row[ok], w[ok] / long[row[ok]], asked[ok]
                lens = x["at"][asked + 1] - x["at"][asked]
                to = _ranges(x["at"][asked], lens)
                score = np.round(np.bincount(np.repeat(row, lens) * many + x["query"][to], np.repeat(w, lens) * x["w"][to], rows * many).reshape(rows, many), 9)
                low = np.partition(score, rows - k, axis=0)[rows - k] if rows > k else 0.0
                row, found = np.nonzero((score > least) & (score >= np.maximum(kth, low)))
                if len(row):
                    q, s = np.concatenate([q, found]), np.concatenate([s, score[row, found]])
                    ids = own[begin + row] if ids is None else np.concatenate([ids, own[begin + row]])
                    best = _first(q, s, ids, k)
                    q, s, ids = q[best], s[best], ids[best]
                    full = np.bincount(q, minlength=many) == k
                    lowest = np.full(many, np.inf)
                    np.minimum.at(lowest, q, s)
                    kth[full] = lowest[full]
        if len(q):
            targets = [v.decode("utf-8") for v in ids] if ids.dtype == object else ids
            yield pa.RecordBatch.from_arrays([x["ids"].take(pa.array(q)), pa.array(targets, types[1]), pa.array(s)], names=["q", "t", "score"])

    return run


def top_k(queries: DataFrame, targets: DataFrame, text: str, n: int | None, k: int, least: float, min_df: int, max_df: float, left_id: str, right_id: str) -> DataFrame | None:
    """(left, right, score, rank) by the words of ``text``, or by its distinct n-grams; None if queries or terms are too many.

    Ids have neither nulls nor repeats.
    """
    spark = queries.sparkSession
    if (n is not None and n > LONGEST) or queries.count() > FEW or any(dict(x.dtypes)[i] not in ("string", "bigint", "int") for x, i in ((queries, left_id), (targets, right_id))):
        return None
    asked = queries.select(left_id, text).toArrow()
    if not len(asked) or (found := _terms(asked[text].combine_chunks(), n)) is None or len(found[3]) > TERMS:
        return None
    row, place, tf, terms = found
    kind = "string" if n is None else "long"
    counts = targets.select(text).mapInArrow(_counter(n), f"term {kind}, df long").groupBy("term").agg(F.sum("df").alias("df"))
    counts.write.parquet(path := io.work_path(spark, "counts"))
    counts = spark.read.schema(counts.schema).parquet(path)
    often = counts.where("df > 1")
    if not counts.where("term is null").isEmpty() or often.count() > (WORDS if n is None else NUMBERS):
        return None
    total = targets.count()

    def idf(df: np.ndarray) -> np.ndarray:
        return np.where((df >= min_df) & (df <= max_df * total), np.log((1 + total) / (1 + df)) + 1, 0.0)

    own = spark.createDataFrame([(x,) for x in (terms.to_pylist() if n is None else terms.tolist())], f"term {kind}")
    known = dict(counts.join(F.broadcast(own), "term").collect())  # at most TERMS rows
    df = np.array([known.get(x, 0) for x in (terms.to_pylist() if n is None else terms.tolist())], np.int64)
    w = (1 + np.log(tf)) * np.where(df > 0, idf(df), 0.0)[place]
    long = np.sqrt(np.bincount(row, w * w, len(asked)))
    row, place, w = row[w > 0], place[w > 0], w[w > 0]  # in the order of terms
    often = often.select("term", F.col("df").cast("int").alias("df")) if n is None else often.select(F.col("term").cast("int").alias("term"), F.col("df").cast("int").alias("df")).orderBy("term")
    often = often.toArrow()
    shared = spark.sparkContext.broadcast({
        "ids": asked[left_id].combine_chunks(), "asked": terms, "at": np.searchsorted(place, np.arange(len(terms) + 1)), "query": row, "w": w / long[row],
        "terms": often["term"].combine_chunks() if n is None else often["term"].to_numpy(), "idf": idf(often["df"].to_numpy()), "once": float(idf(np.array([1]))[0]),
    })
    types = dict(queries.dtypes)[left_id], dict(targets.dtypes)[right_id]
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    rows = targets.select(right_id, text).mapInArrow(_scorer(shared, n, k, least, tuple(arrow[x] for x in types)), f"q {types[0]}, t {types[1]}, score double")
    rows = rows.select(F.col("q").alias(left_id), F.col("t").alias(right_id), "score")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(left_id).orderBy(F.desc("score"), right_id))).where(F.col("rank") <= k)
