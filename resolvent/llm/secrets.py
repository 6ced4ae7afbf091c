"""Operator 2: secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are
reported wherever they stand.  Weak candidates (identifier-like, secret-like
and endpoint-like strings) mean little alone: each is an interval, widened by a
reach and confined to its scope, and is reported only if an interval of a
complementary part lies within it.  The interval join is a search in sorted
positions within one document, so its cost follows the number of parts.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch

# The strong patterns.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs, so that asking for 24 in the pattern finds what filtering runs would.
HEX = re.compile(r"[0-9a-f]{24,}")

IDENT = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"https?://[^\x00-\x20\"'<>]{4,}")

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")


def entropy(s: str) -> float:
    """Bits per character of a string's own distribution."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def strong_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong patterns: leftmost, not overlapping within a kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def weak_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates that count only next to a complementary part."""
    found = [(m.start(), m.end(), "ident") for m in IDENT.finditer(text)]
    for m in SECRET.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and entropy(s) >= 3.5:
            found.append((m.start(), m.end(), "secret"))
    if "://" in text:
        found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    return found


#: The role of each kind, and the roles that complete it.
ROLE = {"assign": "secret", "hex": "secret", "access": "ident", "ident": "ident", "secret": "secret", "endpoint": "endpoint"}
NEEDS = {"ident": ("secret",), "secret": ("ident",), "endpoint": ("ident", "secret")}


def link_parts(text: str, strong: list[tuple[int, int, str]], reach: int) -> list[tuple[int, int, str]]:
    """The weak candidates that an interval join confirms.

    A part's interval is its span widened by ``reach`` on both sides, cut at the
    scope (a stretch without an empty line).  An identifier needs a secret
    whose span reaches into its interval, a secret an identifier, an endpoint
    both; a part that overlaps the candidate itself does not count.  Candidates
    that overlap a strong span are that span and not reported again.
    """
    weak = weak_spans(text)
    if not weak:
        return []
    s_starts, s_ends = [x[0] for x in strong], []
    high = 0
    for x in strong:
        high = max(high, x[1])
        s_ends.append(high)

    def covered(a: int, b: int) -> bool:
        i = bisect_left(s_starts, b)
        return i > 0 and s_ends[i - 1] > a

    weak = [x for x in weak if not covered(x[0], x[1])]
    parts = strong + weak
    roles = {x[2] for x in parts}
    if not ({"ident", "access"} & roles and {"secret", "assign", "hex"} & roles):
        return []
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    by_role: dict[str, list[tuple[int, int]]] = {"ident": [], "secret": [], "endpoint": []}
    for a, b, kind in parts:
        by_role[ROLE[kind]].append((a, b))
    # Spans by start, with the furthest end so far: those that begin before a point and reach another are found from the back.
    held = {r: sorted(x) for r, x in by_role.items()}
    starts = {r: [a for a, _ in x] for r, x in held.items()}
    furthest = {r: list(accumulate((b for _, b in x), max)) for r, x in held.items()}

    def meets(a: int, b: int, role: str) -> bool:
        """Whether a span of the role overlaps this span's interval, but not the span itself."""
        at = bisect_right(breaks, a)
        low = max(a - reach, breaks[at - 1] if at else 0)
        high = min(b + reach, breaks[at] if at < len(breaks) else len(text))
        i = bisect_left(starts[role], high) - 1
        while i >= 0 and furthest[role][i] > low:
            x, y = held[role][i]
            if y > low and (y <= a or x >= b):
                return True
            i -= 1
        return False

    return [x for x in weak if all(meets(x[0], x[1], r) for r in NEEDS[ROLE[x[2]]])]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(reach: int, text_at: int):
    schema = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string())])

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for t in batch.column(text_at):
                text = t.as_py() or ""
                base = strong_spans(text)
                spans = sorted(base + link_parts(text, base, reach), key=lambda x: (x[0], KINDS.index(x[2])))
                count = Counter(k for _, _, k in base)
                for c, v in zip(cols, (count["assign"], count["access"], count["hex"], joined(base), joined(spans)), strict=True):
                    c.append(v)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)]], names=[*names, *schema.names])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base, spans) for every row of ``docs``.

    ``base`` and ``spans`` list ``kind:start:end`` by start, then kind, in code
    points with the end exclusive; ``spans`` adds the linked weak parts.  A null
    or empty text has none.  Whole texts are scanned, of any length.  Repeated
    rows give repeated results; other columns are not read; an empty table gives
    an empty table.
    """
    x = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = x.mapInArrow(_scan(reach, 1), "id long, n_assign long, n_access long, n_hex long, base string, spans string")
    # Written here, with few texts at once in a Python worker.
    return Scratch(docs.sparkSession).cut(out, "spans").withColumnRenamed("id", id_col)


def digest(spans: str) -> str:
    """The lowercase hexadecimal SHA-256 that ``base_sha256`` holds."""
    return hashlib.sha256(spans.encode()).hexdigest()


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
