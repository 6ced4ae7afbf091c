"""Vectorised text primitives over Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+``.  These separators are single bytes that no
multi-byte UTF-8 sequence holds, so words are cut on the bytes of a whole Arrow
buffer at once.  Hashes are 64 bits and do not depend on the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 18
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) + U(seed))


_BYTE = stream(256, 11)
_BASE = int(stream(1, 12)[0]) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(19, int(n).bit_length())
    if size not in _powers:
        if len(_powers) > 1:
            _powers.pop(max(_powers))
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.ones(size, np.uint64)
            have = 1
            while have < size:
                p[have : 2 * have] = p[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            out.append(p)
        _powers[size] = tuple(out)
    return _powers[size]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets): the rows of a string column, about CHUNK bytes at once; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    if len(texts) == 0:
        return
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        b = min(b, n)
        yield a, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def cut_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words do not cross rows."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(raw)]
    begin[inner] = word[inner]
    starts = np.flatnonzero(begin)
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    ends_at = inner[inner > 0] - 1
    stop[ends_at] = word[ends_at]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(raw: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Hashes of several lists of byte spans (starts, ends) that do not depend on where a span stands."""
    p, inv = _power_table(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * p[: len(raw)], out=sums[1:])
    return [mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64)) for starts, ends in spans]


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span that does not depend on where it stands."""
    return span_hashes(raw, [(starts, ends)])[0]


_GRAM = stream(16, 13) | U(1)


def grams(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every window of k words; a row of fewer words gives one hash of them all."""
    n = len(words)
    if n == 0:
        return words, rows
    if n >= k:
        h = words[: n - k + 1] * _GRAM[0]
        for j in range(1, k):
            h = h + words[j : n - k + 1 + j] * _GRAM[j]
        full = rows[: n - k + 1] == rows[k - 1 :]
        h, r = mix(h[full]), rows[: n - k + 1][full]
    else:
        h, r = words[:0], rows[:0]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[first, n])
    short = count < k
    if short.any():
        more = np.zeros(int(short.sum()), np.uint64)
        f, c = first[short], count[short]
        for j in range(k - 1):
            has = c > j
            more[has] += words[f[has] + j] * _GRAM[j]
        more = mix(more + c.astype(np.uint64) * _GRAM[15])
        h, r = np.r_[h, more], np.r_[r, rows[f]]
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64) if x.dtype == np.uint64 else x
