"""Operator 7: removal of fuzzy duplicate lines by MinHash.

A line's signature is a one-permutation MinHash over its 5-character shingles;
bands of it give buckets, inside which all pairs are held against each other by
the exact Jaccard similarity of the whole lines; union-find joins the pairs that
link, and of every component one line stays, the first by (document id, line
number).

What leaves a bucket is a group of lines, not its pairs: a 50-bit sketch of the
signature drops the lines that only share common shingles with the rest, equal
groups of several bands are one, and a group's links leave it as a spanning
forest.  A bucket of more than BLOCK lines is tested in blocks that share its
first line; only blocks whose lines are then still in different components meet
each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _vec as V
from ._graph import components
from ._scratch import Scratch
from ._skew import HOT, frequent, join_unique

BANDS, ROWS = 10, 5
#: Lines of a bucket that one block holds; pairs of blocks are the unit of work.
BLOCK = 1000
#: Bits of the sketch that two lines at the threshold share (one bit a value; 44 are expected, standard deviation 2.3).
ALIKE = 35
#: Values without a shingle of their own from which on a sketch says too little about a (short) line.
POOR = 10
#: Characters from which on a blank line is a line like any other; a shorter one is layout.
BLANK = 32
_FILL = V.stream(64, 31)


#: Characters of lines that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 18
_SPACES = " \t\n\x0b\x0c\r"


def codepoints(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all lines one after the other, and where each line begins (and the last ends)."""
    offsets = np.zeros(len(lines) + 1, np.int64)
    np.cumsum([len(x) for x in lines], out=offsets[1:])
    return np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32), offsets


def _lines(texts: pa.Array, shortest: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(rows, line numbers, lines): all lines of at least ``shortest`` characters but short blank ones."""
    rows: list[int] = []
    numbers: list[int] = []
    lines: list[str] = []
    held = 0
    for i, value in enumerate(texts):
        text = value.as_py()
        if not text:
            continue
        for n, x in enumerate(text.split("\n")):
            if len(x) >= shortest and (len(x) >= BLANK or x.strip(_SPACES)):
                rows.append(i)
                numbers.append(n)
                lines.append(x)
        held += len(text)
        if held >= CHUNK and lines:
            yield rows, numbers, lines
            rows, numbers, lines, held = [], [], [], 0
    if lines:
        yield rows, numbers, lines


def _identity(lines: list[str]) -> np.ndarray:
    """128 bits (line, 2) that name a line's text."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.int64).reshape(-1, 2)


def _occurrences(shortest: int):
    schema = pa.schema([("id", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches):
        for batch in batches:
            for rows, numbers, lines in _lines(batch.column(2), shortest):
                h, at = _identity(lines), pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], schema=schema)

    return run


def _spans(s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all spans (start, size) one after the other, and the span of each."""
    of = np.repeat(np.arange(len(s), dtype=np.int32), size)
    begin = np.cumsum(size) - size
    return np.arange(len(of), dtype=np.int32) + (s - begin).astype(np.int32)[of], of


_GRAM32 = (V.stream(8, 41) | np.uint64(1)).astype(np.uint32)


def _grams32(cp: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of the k characters from every position on (of fewer, at the end, none)."""
    n = len(cp) - k + 1
    if n <= 0:
        return np.zeros(1, np.uint32)
    h = cp[:n] * _GRAM32[0]
    for j in range(1, k):
        h += cp[j : n + j] * _GRAM32[j % 8]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def minhash(cp: np.ndarray, s: np.ndarray, e: np.ndarray, k: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation MinHash (line, bin), and how many bins of a line borrow from a fixed walk over the others."""
    at, of = _spans(s, np.maximum(e - s - k + 1, 1))
    h = _grams32(cp, k)
    h = h[np.minimum(at, len(h) - 1)]
    bin_ = (((h * np.uint32(0x9E3779B1)) >> np.uint32(16)) * np.uint32(bins)) >> np.uint32(16)
    none = np.uint32(0xFFFFFFFF)
    sig = np.full(len(s) * bins, none, np.uint32)
    np.minimum.at(sig, of.astype(np.int64) * bins + bin_, h)
    sig = sig.reshape(len(s), bins)
    lent_to = (sig == none).sum(axis=1)
    left = np.flatnonzero(lent_to)  # lines that still have empty bins
    own = sig[left]
    for step in range(1, 64):
        if not len(left):
            break
        # Each bin has a walk of its own, so borrowed values of two lines agree as often as their own do.
        source = ((np.arange(bins, dtype=np.uint64) * np.uint64(2 * step + 1) + _FILL[step]) % np.uint64(bins)).astype(np.int64)
        lent, got = own[:, source], sig[left]
        good = (got == none) & (lent != none)
        got[good] = lent[good] ^ np.uint32(step * 0x9E3779B1 & 0xFFFFFFFF)
        sig[left] = got
        more = (got == none).any(axis=1)
        left, own = left[more], own[more]
    return sig, lent_to


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (line, band) of signatures."""
    values = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 % (1 << 60)), (len(sig), bands))
    for j in range(rows):
        key = V.mix((key ^ values[:, :, j]) * _ODD[0] + _ODD[1])
    return key


def signatures(cp: np.ndarray, s: np.ndarray, e: np.ndarray, k: int, bands: int, rows: int) -> np.ndarray:
    """Band keys (line, band) of lines."""
    return band_keys(minhash(cp, s, e, k, bands * rows)[0], bands, rows)


def sketches(sig: np.ndarray, lent_to: np.ndarray) -> np.ndarray:
    """A bit of each of the first 62 values, and bit 62 where a line has too few shingles for them to say much."""
    bits = (V.mix(sig[:, :62]) & np.uint64(1)) << np.arange(min(62, sig.shape[1]), dtype=np.uint64)[None, :]
    return bits.sum(axis=1, dtype=np.uint64) | ((lent_to > POOR).astype(np.uint64) << np.uint64(62))


_ODD = V.stream(2, 47) | np.uint64(1)


def _band_rows(shortest: int, k: int, bands: int, rows: int):
    schema = pa.schema([("band", pa.int64()), ("h1", pa.int64()), ("sketch", pa.int64())])

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, lines in _lines(batch.column(0), shortest):
                h1, new = _identity(lines)[:, 0], []
                for i, h in enumerate(h1.tolist()):
                    if h not in seen:
                        if len(seen) < 300_000:
                            seen.add(h)
                        new.append(i)
                if new:
                    cp, offs = codepoints([lines[i] for i in new])
                    sig, lent_to = minhash(cp, offs[:-1], offs[1:], k, bands * rows)
                    key, bits = band_keys(sig, bands, rows), V.signed(sketches(sig, lent_to))
                    yield pa.RecordBatch.from_arrays([pa.array(V.signed(key.ravel())), pa.array(np.repeat(h1[new], bands)), pa.array(np.repeat(bits, bands))], schema=schema)

    return run


def _runs(batches, most: int):
    """(columns, piece): runs of equal values of the first column of sorted batches.

    Columns hold whole runs only, for which ``piece`` is None; a run that goes on
    over more than ``most`` rows and a batch comes in pieces of its own, numbered from 0.
    """
    held, piece = None, 0
    for batch in batches:
        cols = batch if held is None else pa.Table.from_batches([*held, batch]).combine_chunks().to_batches(max_chunksize=None)[0]
        held = None
        if not cols.num_rows:
            continue
        key = cols.column(0).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
        if piece and last:  # the long run ends here
            end = int(np.flatnonzero(key[1:] != key[:-1])[0]) + 1
            for at in range(0, end, most):
                yield cols.slice(at, min(most, end - at)), piece + at // most
            cols, last, piece = cols.slice(end), last - end, 0
        if last:
            yield cols.slice(0, last), None
        rest = cols.slice(last)
        while rest.num_rows > most:
            yield rest.slice(0, most), piece
            rest, piece = rest.slice(most), piece + 1
        held = [rest] if rest.num_rows else None
    if held is not None:
        yield held[0], piece or None


def _linked(rows: np.ndarray) -> Iterator[np.ndarray]:
    """The members of every component of a symmetric boolean matrix that has more than one."""
    left = rows.any(axis=1)
    while left.any():
        mine = np.zeros(len(rows), bool)
        edge = np.array([int(np.argmax(left))])
        while len(edge):
            mine[edge] = True
            edge = np.flatnonzero(rows[edge].any(axis=0) & ~mine)
        left &= ~mine
        yield np.flatnonzero(mine)


def _groups(alike: int, block: int):
    """Rows (g, h1) of groups whose pairs have to be tested; lines of long buckets also give their band."""
    schema = pa.schema([("g", pa.int64()), ("h1", pa.int64()), ("band", pa.int64())])
    poor, value = np.uint64(1 << 62), np.uint64((1 << 62) - 1)

    def rows(g, h1, band=None):
        return pa.RecordBatch.from_arrays([pa.array(V.signed(g)), pa.array(h1), pa.nulls(len(h1), pa.int64()) if band is None else pa.array(band)], schema=schema)

    def agree(x, y, bins):
        """Whether two sketches do not rule out a link."""
        return (bins - np.bitwise_count((x ^ y) & value) >= alike) | ((x | y) & poor != 0)

    def run(batches):
        first = None
        for cols, piece in _runs(batches, block):
            band, h1, sketch = (cols.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.lexsort((h1, band))
            band, h1, sketch = band[order], h1[order], sketch[order].view(np.uint64)
            new = np.r_[True, (band[1:] != band[:-1]) | (h1[1:] != h1[:-1])]  # a line that several tasks saw stands once
            band, h1, sketch = band[new], h1[new], sketch[new]
            if piece is not None:
                g = V.mix(np.array([band[0], piece], np.int64).view(np.uint64)).sum(keepdims=True)
                if piece == 0:
                    first = h1[:1]
                else:
                    yield rows(g, first)
                yield rows(np.repeat(g, len(h1)), h1, band)
                continue
            start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            size = np.diff(np.r_[start, len(band)])
            two = start[size == 2]
            two = two[agree(sketch[two], sketch[two + 1], BANDS * ROWS)]
            if len(two):
                g = V.mix(V.mix(h1[two].view(np.uint64)) + V.mix(h1[two + 1].view(np.uint64)))
                yield rows(np.r_[g, g], np.r_[h1[two], h1[two + 1]])
            out = []
            for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                x = sketch[a : a + n]
                may = agree(x[:, None], x[None, :], BANDS * ROWS)
                np.fill_diagonal(may, False)
                out += [h1[a + at] for at in _linked(may)]
            if out:
                g = np.array([V.mix(x.view(np.uint64)).sum() for x in out], np.uint64)
                yield rows(np.repeat(V.mix(g), [len(x) for x in out]), np.concatenate(out))

    return run


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of one hash over the column ``h1``: 16 bits a row, 128 KB at least and 32 MB at most."""
    size = 1 << min(28, max(20, (16 * ids.count()).bit_length()))
    b = F.col("h1").bitwiseAND(F.lit(size - 1))
    words = ids.select(F.shiftright(b, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(31)).cast("int")).alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    out = np.zeros(size >> 5, np.uint32)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy(zero_copy_only=False)] = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
    return out


def _texts(shortest: int, bits):
    schema = pa.schema([("h1", pa.int64()), ("line", pa.string())])

    def run(batches):
        have, seen = bits.value, set()
        for batch in batches:
            for _, _, lines in _lines(batch.column(0), shortest):
                h1 = _identity(lines)[:, 0]
                at = h1 & (len(have) * 32 - 1)
                ids, out = [], []
                for i in np.flatnonzero((have[at >> 5] >> (at & 31).astype(np.uint32)) & 1).tolist():
                    h = int(h1[i])
                    if h not in seen:
                        if len(seen) < 50_000:
                            seen.add(h)
                        ids.append(h)
                        out.append(lines[i])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], schema=schema)

    return run


def shingles(text: str, k: int) -> set[str]:
    """The k-character shingles of a line; a shorter line is its own."""
    return {text[i : i + k] for i in range(max(1, len(text) - k + 1))}


def _grams(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of the shingles of every line, in order; hashes have 64 bits."""
    cp, offs = codepoints(lines)
    size = np.diff(offs)
    at, of = _spans(offs[:-1], np.maximum(size - k + 1, 1))
    v = np.r_[cp, np.zeros(k, np.uint32)].astype(np.uint64)
    v += np.uint64(1)
    if (size < k).any():  # a shorter line is its own shingle: nothing of the next line counts
        ends = np.repeat(offs[1:], np.maximum(size - k + 1, 1))
        h = sum((np.where(at + j < ends, v[at + j], np.uint64(0)) * _ODD5[j] for j in range(k)), np.zeros(len(at), np.uint64))
    else:
        h = v[: len(cp)] * _ODD5[0]
        for j in range(1, k):
            h += v[j : len(cp) + j] * _ODD5[j]
        h = h[at]
    return V.mix(h), of


_ODD5 = V.stream(64, 53) | np.uint64(1)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]]


def _few_linked(lines: list[str], start: np.ndarray, size: np.ndarray, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All links, as rows, inside up to 1024 groups of up to FEW lines each, group after group."""
    group = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(lines)) - np.repeat(start, size)
    h, of = _grams(lines, k)
    # 10 bits of group, 50 of shingle, 4 of line, so that equal shingles of a group stand together.
    keys = _distinct((group.astype(np.uint64) << np.uint64(54))[of] | (h >> np.uint64(14) << np.uint64(4)) | place.astype(np.uint64)[of])
    what, line = keys >> np.uint64(4), (keys & np.uint64(15)).astype(np.int64)
    g = (keys >> np.uint64(54)).astype(np.int64)
    n = np.bincount(g * FEW + line, minlength=len(size) * FEW)
    both = np.zeros(len(size) * FEW * FEW, np.int64)
    for d in range(1, FEW):
        same = np.flatnonzero(what[d:] == what[:-d])
        if not len(same):
            break
        both += np.bincount(g[same] * FEW * FEW + line[same] * FEW + line[same + d], minlength=len(both))
    code = np.flatnonzero(both)
    g, x, y = code // (FEW * FEW), code // FEW % FEW, code % FEW
    ok = 100 * both[code] >= percent * (n[g * FEW + x] + n[g * FEW + y] - both[code])
    return (start[g] + x)[ok], (start[g] + y)[ok]


def _all_linked(lines: list[str], k: int, percent: int) -> np.ndarray:
    """The symmetric matrix of which lines link; shared shingles are counted by matrix products."""
    h, of = _grams(lines, k)
    m = len(lines)
    sets = [_distinct(x) for x in np.split(h, np.flatnonzero(np.diff(of)) + 1)]
    keys, size = np.concatenate(sets), np.array([len(x) for x in sets])
    row = np.repeat(np.arange(m), size)
    order = np.argsort(keys, kind="stable")
    keys, row = keys[order], row[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    shared = ~new | np.r_[~new[1:], False]
    row, column = row[shared], (np.cumsum(new & shared) - 1)[shared]
    both, width = np.zeros((m, m), np.float32), 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        x = np.zeros((m, int(column[b - 1]) - low + 1), np.float32)
        x[row[a:b], column[a:b] - low] = 1
        both += x @ x.T
    np.fill_diagonal(both, 0)
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


#: Lines of a group up to which many groups are tested at once.
FEW = 16


def _tested(k: int, percent: int):
    """The exact Jaccard test (on 50 bits or more of hashed shingles) of all pairs of each group; large groups give a spanning forest of links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for cols, _ in _runs(batches, 1 << 30):
            g, h1 = cols.column(0).to_numpy(zero_copy_only=False), cols.column(1).to_numpy(zero_copy_only=False)
            lines = cols.column(2).to_pylist()
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.diff(np.r_[start, len(g)])
            out = [(h1[:0], h1[:0])]
            few = np.flatnonzero((size > 1) & (size <= FEW))
            for i in range(0, len(few), 1024):
                s, n = start[few[i : i + 1024]], size[few[i : i + 1024]]
                rows = np.concatenate([np.arange(a, a + m) for a, m in zip(s.tolist(), n.tolist(), strict=True)])
                x, y = _few_linked([lines[j] for j in rows.tolist()], np.cumsum(n) - n, n, k, percent)
                out.append((h1[rows[x]], h1[rows[y]]))
            for a, n in zip(start[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
                for at in _linked(_all_linked(lines[a : a + n], k, percent)):
                    out.append((np.full(len(at) - 1, h1[a + at[0]]), h1[a + at[1:]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]), pa.int64()) for i in (0, 1)], schema=schema)

    return run


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 32, k: int = 5, percent: int = 75, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(id, doc, line): every line that repeats, exactly or fuzzily, an earlier one.

    ``doc`` is a hash of the text that tells rows of one id apart; ``line``
    counts from 0.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = scratch.cut(docs.mapInArrow(_occurrences(shortest), "id long, doc long, line int, h1 long, h2 long"), "lines")

    bands = docs.select("text").mapInArrow(_band_rows(shortest, k, BANDS, ROWS), "band long, h1 long, sketch long")
    groups = bands.repartition("band").sortWithinPartitions("band").mapInArrow(_groups(ALIKE, block), "g long, h1 long, band long")
    groups = scratch.cut(groups, "groups")

    def linked(members: DataFrame) -> DataFrame:
        """Links inside the groups (g, h1), on the whole lines."""
        members = scratch.cut(members.distinct(), "members")
        bits = spark.sparkContext.broadcast(_bitmap(members.select("h1").distinct()))
        texts = docs.select("text").mapInArrow(_texts(shortest, bits), "h1 long, line string").dropDuplicates(["h1"])
        held = members.join(texts, "h1").select("g", "h1", "line")
        return scratch.cut(held.repartition("g").sortWithinPartitions("g").mapInArrow(_tested(k, percent), "a long, b long"), "links")

    links = linked(groups.select("g", "h1"))
    comp = scratch.cut(components(spark, links, scratch), "components")
    long_buckets = groups.where("band is not null").select("band", "h1").distinct()
    if not long_buckets.isEmpty():
        one = Window.partitionBy("band")
        rest = long_buckets.join(comp, F.col("h1") == F.col("id"), "left").select("band", "h1", F.coalesce("component", "h1").alias("comp"))
        rest = rest.withColumn("lo", F.min("comp").over(one)).withColumn("hi", F.max("comp").over(one)).where("lo <> hi").select("band", "h1", "comp")
        rest = rest.withColumn("block", F.expr(f"(row_number() over (partition by band order by comp, h1) - 1) div {block}"))
        rest = scratch.cut(rest, "rest")
        blocks = rest.groupBy("band", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        x, y = blocks.alias("x"), blocks.alias("y")
        # Blocks within one and the same component need no test.
        meet = x.join(y, F.expr("x.band = y.band and x.block <= y.block and not (x.lo = x.hi and x.lo = y.lo and y.lo = y.hi)"))
        meet = meet.select("x.band", F.xxhash64("x.band", "x.block", "y.block").alias("g"), F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"))
        links = links.union(linked(rest.join(meet, ["band", "block"]).select("g", "h1")))
        comp = scratch.cut(components(spark, links, scratch), "components")

    # Exact copies share (h1, h2); fuzzy ones the smallest h1 of their component.
    least = [F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("none"), F.count("*").alias("n")]
    texts = found.groupBy("h1", "h2").agg(*least).withColumnRenamed("id", "least")
    named = texts.join(comp, F.col("h1") == F.col("id"), "left").select("h1", "h2", "least", "none", "n", F.coalesce("component", "h1").alias("c1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(0).alias("c2"))
    named = scratch.cut(named, "named")
    classes = named.groupBy("c1", "c2").agg(F.min("least").alias("least"), F.max("none").alias("none"), F.sum("n").alias("total")).where("total > 1").drop("total")
    answers = scratch.cut(join_unique(named.drop("least", "none"), classes, ["c1", "c2"], hot=frequent(named, ["c1", "c2"], scratch)), "answers")
    # Lines that stand very often are fewer than HOT, so they are broadcast and their rows stay where they are.
    hot = answers.where(F.col("n") > found.count() // HOT).select("h1", "h2")
    rows = join_unique(found, answers.drop("n"), ["h1", "h2"], hot=hot)
    # Rows of the first document of a class are told apart by text and line.
    first = F.when(F.col("none"), F.col("id").isNull()).otherwise(F.col("id") == F.col("least"))
    rows = scratch.cut(rows.select("id", "doc", "line", "c1", "c2", first.alias("first")), "rows")
    inside = Window.partitionBy("c1", "c2").orderBy("doc", "line")
    same = rows.where("first").withColumn("nth", F.dense_rank().over(inside)).where("nth > 1").select("id", "doc", "line")
    return rows.where("not first").select("id", "doc", "line").union(same)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 32, k: int = 5, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """``docs`` with its repeated lines taken out, and ``dropped_lines`` (long).

    Lines end at ``\\n``.  Of lines that are equal or whose sets of k-character
    shingles have a Jaccard similarity of at least ``percent`` / 100 (joined by
    links), the first by (id, text hash, line number) stays; a null id comes
    first.  Lines of fewer than ``shortest`` characters, and blank
    ones of fewer than BLANK, are left alone.  A null
    or empty text stays as it is.  Rows of equal id and text are one document
    and get the same result.  A document that loses every line gets the empty
    text.  All columns of ``docs`` are kept (one named dropped_lines is replaced); an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    repeated = duplicate_lines(docs, id_col, text_col, shortest, k, percent, block, scratch)
    per_doc = scratch.cut(repeated.groupBy("id", "doc").agg(F.array_sort(F.collect_set(F.col("line"))).alias("gone")), "gone")
    per_doc = per_doc.select(F.col("id").alias("__id"), F.col("doc").alias("__doc"), F.col("gone").alias("__gone"))
    at = docs[id_col].cast("long").eqNullSafe(per_doc["__id"]) & (F.xxhash64(docs[text_col]) == per_doc["__doc"])
    joined = docs.join(per_doc, at, "left")
    lines = F.expr(f"split(`{text_col}`, '\\n', -1)")
    joined = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), lines))
    rest = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(
        F.expr("array_join(transform(array_except(sequence(0, size(__lines) - 1), __gone), i -> __lines[i]), '\\n')")
    )
    dropped = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long")
    names = [F.col(f"`{c}`") if c != text_col else rest.alias(text_col) for c in docs.columns if c != "dropped_lines"]
    return joined.select(*names, dropped.alias("dropped_lines"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines in all, lines dropped, words and characters left, and a digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, shortest=1)
    return out.select("doc_id", "dropped_lines", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
