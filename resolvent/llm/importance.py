"""Operator 9: quality classification by importance resampling.

Two generative models of hashed n-grams are compared: of the target (labelled
rows that are good) and of the raw text (all documents).  A document's weight
is the sum over its n-grams of log(target / raw); Gumbel top-k draws documents
without replacement in proportion to the weights, with k a parameter or the
number of documents whose weight is not negative (the cuts from which weights
are measured are fitted on labelled rows).

Two such ratios are taken.  The first is over words, word pairs, word shapes
(runs of character classes), shape pairs and a marker for a word that repeats
the one before; the shapes carry what a hashed word alone cannot, such as
shouting or stray symbols.  It grows with the text, so the few words that make a
text unfit would drown in it; the second is over words without their
punctuation, and their beginnings (which words of one stem share), and adds up
only those that good text all but lacks.  The weight is the smaller of the two,
each measured from its cut.  Buckets whose two rates do not differ significantly
weigh nothing, so that rare words of clean text do not add up to noise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._scratch import Scratch

#: Labelled rows used to fit the target model and the cut, at most; chosen by a hash of the id.
MAX_LABELLED = 50_000
#: log2 of the number of buckets; the models are two vectors of this size whatever the corpus.
LOG_BUCKETS, LOG_CORE = 18, 20
#: Pseudo-counts that pull a bucket's target rate to its raw rate.
PRIOR, PRIOR_CORE = 5.0, 2.0
#: Log ratio under which a word or beginning counts as one that good text lacks.
LACKS = -1.5
#: Standard errors by which a bucket's rates differ to count.
SIGNIFICANT = 4.0
#: Bytes of the beginnings of longer words.
STEMS = (4, 5, 6)
#: Rejected rows that a cut may let through to keep one good row (as shares of both).
KEEP = 3.0

_CLASS = np.zeros(256, np.uint8)
_CLASS[:] = 4
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 1
_SALT = V.stream(8, 91) | np.uint64(1)
_STEM = V.stream(32, 177) | np.uint64(1)


def features(raw: np.ndarray, offsets: np.ndarray, log_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram of the rows; words without punctuation, and their beginnings, come in buckets of their own, behind the others."""
    s, e, r = V.cut_words(raw, offsets)
    if not len(s):
        z = np.zeros(0, np.int64)
        return z, z
    lower = V.lower_ascii(raw)
    low = V.span_hash(lower, s, e)
    cls = _CLASS[raw]
    turn = np.r_[True, cls[1:] != cls[:-1]]
    turn[s] = True
    at = np.flatnonzero(turn)
    shape = V.span_hash(cls[at], np.searchsorted(at, s), np.searchsorted(at, e))
    same = r[1:] == r[:-1]
    pair = low[:-1] * _SALT[0] + low[1:] * _SALT[1]
    shapes = shape[:-1] * _SALT[2] + shape[1:] * _SALT[3]
    again = same & (low[1:] == low[:-1])
    hashes = np.concatenate([V.mix(low), V.mix(pair[same]), V.mix(shape * _SALT[4]), V.mix(shapes[same]), np.full(int(again.sum()), _SALT[5])])
    rows = np.concatenate([r, r[1:][same], r, r[1:][same], r[1:][again]])
    bare = np.where(cls == 4, np.uint8(0x20), lower)
    cs, ce, cr = V.cut_words(bare, offsets)
    longer = [ce - cs > n for n in STEMS]
    hashed = V.span_hashes(bare, [(cs, ce), *[(cs[at], cs[at] + n) for at, n in zip(longer, STEMS, strict=True)]])
    core = np.concatenate([V.mix(hashed[0]), *[V.mix(h * _STEM[n]) for h, n in zip(hashed[1:], STEMS, strict=True)]])
    core = (core >> np.uint64(64 - LOG_CORE)).astype(np.int64) + (1 << log_buckets)
    return np.concatenate([(hashes >> np.uint64(64 - log_buckets)).astype(np.int64), core]), np.concatenate([rows, cr, *[cr[at] for at in longer]])


def _counts(log_buckets: int):
    """(bucket, n) of a task's texts."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros((1 << log_buckets) + (1 << LOG_CORE), np.int64)
        for batch in batches:
            for _, raw, offsets in V.chunks(batch.column(0)):
                b, _ = features(raw, offsets, log_buckets)
                np.add.at(total, b, 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000].astype(np.int32)), pa.array(total[at[i : i + 100_000]])], schema=schema)

    return run


def _vector(texts: DataFrame, log_buckets: int) -> np.ndarray:
    """Counts by bucket over all rows; the driver gets one row per bucket at most."""
    rows = texts.mapInArrow(_counts(log_buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros((1 << log_buckets) + (1 << LOG_CORE))
    for batch in rows.toArrow().to_batches():
        out[batch.column(0).to_numpy(zero_copy_only=False)] = batch.column(1).to_numpy(zero_copy_only=False)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log of the target's rate over the raw rate by bucket; 0 where they do not differ significantly."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + prior) / (expected + prior))
    spread = np.sqrt(np.maximum(expected, 1.0))
    return np.where(np.abs(target - expected) >= SIGNIFICANT * spread, ratio, 0.0)


def model(target: np.ndarray, raw: np.ndarray, log_buckets: int) -> np.ndarray:
    """The weights of all buckets: the ratio of the n-grams, and of the bare words that good text lacks."""
    n = 1 << log_buckets
    core = log_ratio(target[n:], raw[n:], PRIOR_CORE)
    return np.r_[log_ratio(target[:n], raw[:n]), np.where(core < LACKS, core, 0.0)].astype(np.float32)


def _scores(weights, log_buckets: int, text: bool = False):
    """Adds the two sums of weights; the text, which is the last column, is passed on or left out."""
    schema = pa.schema([("w_all", pa.float64()), ("w_core", pa.float64())])

    def run(batches):
        w = weights.value
        for batch in batches:
            sums = np.zeros((2, batch.num_rows))
            for first, raw, offsets in V.chunks(batch.column(batch.num_columns - 1)):
                b, r = features(raw, offsets, log_buckets)
                k, core = len(offsets) - 1, b >= 1 << log_buckets
                for i, part in enumerate((~core, core)):
                    sums[i, first : first + k] = np.bincount(r[part], weights=w[b[part]], minlength=k)
            kept = batch.columns if text else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums[0]), pa.array(sums[1])], names=[*batch.schema.names[: len(kept)], *schema.names])

    return run


def _cut(score: np.ndarray, good: np.ndarray) -> float:
    """The cut that makes the share of rejected rows under it, less KEEP times that of good ones, largest; in the middle of its gap."""
    if not len(good) or good.all() or not good.any():
        return -1e300
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order]
    lost = np.r_[0, np.cumsum(g)] / g.sum()
    caught = np.r_[0, np.cumsum(~g)] / (~g).sum()
    gain = caught - KEEP * lost
    gain[1:-1][s[1:] == s[:-1]] = -KEEP
    i = int(np.argmax(gain))
    if i == 0:
        return -1e300
    return float(s[i - 1] + s[i]) / 2 if i < len(s) else float(s[-1]) + 1


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good_col: str = "good", seed: int = 7, k: int | None = None, max_labelled: int = MAX_LABELLED, log_buckets: int = LOG_BUCKETS, with_text: bool = True) -> DataFrame:
    """``docs`` with ``log_weight`` (double), ``gumbel_key`` (double) and ``kept`` (boolean).

    ``labels`` has ``id_col`` and a boolean ``good_col``; of an id labelled both
    ways the row is not good, and null labels are not read.  The target model
    and the cut take ``max_labelled`` rows at most (smallest hashes of the id);
    the raw model and the scores take all documents.  ``gumbel_key`` is
    log_weight + Gumbel(seed, id, text); the ``k`` largest keys are kept, by
    default as many as there are weights of 0 or more.  ``kept`` is decided by
    the k-th key itself: ties with it, and so repeated rows, are all kept.  A
    null or empty text weighs 0 and is judged like any other, a null id has no
    label; whole texts are read, of any length.  ``with_text`` false leaves the
    text out of the result.  With no labelled row of either class, all are kept.
    Columns of ``docs`` named like the new ones are replaced; an empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    new = ("log_weight", "gumbel_key", "kept")
    docs = docs.drop(*new)
    text = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    raw = _vector(text, log_buckets)

    sure = labels.where(F.col(id_col).isNotNull() & F.col(good_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(F.col(good_col).cast("boolean")).alias("__good"))
    sure = sure.orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(max_labelled)  # the documented bound of the fit
    sure = scratch.cut(sure, "labels")
    mine = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    mine = mine.join(F.broadcast(sure), "__id")  # at most max_labelled short rows
    # An id that stands on several rows is read from one of them, that with the smallest text.
    mine = mine.groupBy("__id", "__good").agg(F.min("__text").alias("__text")).select("__good", "__text")
    mine = scratch.cut(mine, "labelled")
    weights = model(_vector(mine.where("__good").select("__text"), log_buckets), raw, log_buckets)
    sent = spark.sparkContext.broadcast(weights)
    sums = "w_all double, w_core double"
    fitted = mine.mapInArrow(_scores(sent, log_buckets), f"__good boolean, {sums}").toPandas()
    good, first, second = (fitted[c].to_numpy() for c in ("__good", "w_all", "w_core"))
    cut_all = _cut(first, good.astype(bool))
    passed = first >= cut_all
    cut_core = _cut(second[passed], good[passed].astype(bool))
    weight = F.least(F.col("w_all") - F.lit(float(cut_all)), F.col("w_core") - F.lit(float(cut_core)))

    # The text goes through Python; what else a row has stays on the JVM's side of the row.
    h = F.xxhash64(F.lit(seed), F.col("__id"), F.col("__h"))
    unit = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    gumbel = -F.log(-F.log(unit))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    who = [F.struct(F.lit(0).alias("__"), *rest).alias("__row"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col)).alias("__h")]
    keyed = docs.select(*who, F.col(text_col).cast("string").alias("__text"))
    shape = f"__row {keyed.schema['__row'].dataType.simpleString()}, __id long, __h long, {'__text string, ' if with_text else ''}{sums}"
    scored = keyed.mapInArrow(_scores(sent, log_buckets, with_text), shape).withColumn("log_weight", weight)
    key = F.col("log_weight") + gumbel
    if with_text:  # the texts are scored again rather than written
        slim = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col)).alias("__h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
        slim = slim.mapInArrow(_scores(sent, log_buckets), f"__id long, __h long, {sums}").withColumn("log_weight", weight)
        keys = scratch.cut(slim.select("log_weight", key.alias("key")), "keys")
    else:
        scored = scratch.cut(scored, "scored")
        keys = scored.select("log_weight", key.alias("key"))
    floor = kth_largest(keys, "key", keys.where("log_weight >= 0").count() if k is None else k)
    names = [F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in docs.columns if with_text or c != text_col]
    return scored.select(*names, "log_weight", key.alias("gumbel_key"), (key >= F.lit(floor)).alias("kept"))


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a double column, by histograms that get finer; no sort, no collect of rows."""
    if k <= 0:
        return float("inf")
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if n is None or n == 0:
        return float("inf")
    if k >= n:
        return low
    above = 0  # values over the window [low, high]
    while True:
        width = (high - low) / bins
        inside = df.where(F.col(col).between(low, high))
        if width <= 0 or low + width == low:
            return low
        b = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        # the window's bins, from the largest: at most ``bins`` rows
        got = sorted(inside.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect(), key=lambda r: -r["b"])
        for r in got:
            if above + r["n"] >= k:
                if r["lo"] == r["hi"]:
                    return r["lo"]
                if above + r["n"] == k:
                    return r["lo"]
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, good): good text has quality 1 and is not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = resample(docs, good_labels(spark, sf_dir), with_text=False)
    return out.select("doc_id", F.round("log_weight", 6).alias("log_weight"), "kept")
