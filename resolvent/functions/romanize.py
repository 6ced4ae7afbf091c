"""Indic scripts to ASCII, by rule: nine Unicode blocks share one layout.

A letter's place in its block says what it is, so one table serves all blocks.
Consonants carry an inherent vowel that a vowel sign or virama replaces; it is
not written at the end of a word.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First code points of the blocks from Devanagari to Malayalam; each holds 128.
FIRST, LAST = 0x0900, 0x0D7F
# Vowels, consonants and vowel signs by their place in a block.
VOWELS = dict(zip(range(0x05, 0x15), ("a", "aa", "i", "ee", "u", "oo", "ri", "li", "e", "e", "e", "ai", "o", "o", "o", "au"), strict=True))
CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh n ch chh j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split(), strict=True))
SIGNS = dict(zip(range(0x3E, 0x4D), ("aa", "i", "ee", "u", "oo", "ri", "ri", "e", "e", "e", "ai", "o", "o", "o", "au"), strict=True))
NUKTA = {"k": "q", "kh": "kh", "g": "gh", "j": "z", "d": "r", "dh": "rh", "ph": "f", "y": "y"}
VIRAMA, NUKTA_AT, NASALS, VISARGA, DIGITS = 0x4D, 0x3C, (0x01, 0x02), 0x03, 0x66


def _run(word: str) -> str:
    """A stretch of one Indic word."""
    out: list[str] = []
    open_ = False  # the last consonant still has its inherent vowel
    for i, c in enumerate(word):
        at = (ord(c) - FIRST) % 128
        if at in CONSONANTS:
            if open_:
                out.append("a")
            out.append(CONSONANTS[at])
            open_ = True
        elif at == NUKTA_AT:
            if out:
                out[-1] = NUKTA.get(out[-1], out[-1])
        elif at == VIRAMA:
            open_ = False
        elif at in SIGNS:
            out.append(SIGNS[at])
            open_ = False
        elif at in VOWELS or at in NASALS or at == VISARGA:
            if open_:
                out.append("a")
                open_ = False
            following = (ord(word[i + 1]) - FIRST) % 128 if i + 1 < len(word) else -1
            lips = CONSONANTS.get(following, "")[:1] in ("p", "b", "m")
            out.append(VOWELS.get(at) or ("h" if at == VISARGA else "m" if lips else "n"))
        elif DIGITS <= at < DIGITS + 10:
            out.append(str(at - DIGITS))
            open_ = False
    return "".join(out)


def to_ascii(text: str | None) -> str:
    """Any text as ASCII: Indic by rule, Latin without marks, other scripts dropped."""
    out, word = [], []
    for c in (text or "") + " ":
        if FIRST <= ord(c) <= LAST:
            word.append(c)
            continue
        if word:
            out.append(_run("".join(word)))
            word = []
        out.append(c)
    flat = unicodedata.normalize("NFKD", "".join(out)[:-1] if out else "")
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        flat = flat.replace(a, b)
    return flat.encode("ascii", "ignore").decode()


def _batch(s: pd.Series) -> pd.Series:
    table = {v: to_ascii(v) for v in s.dropna().unique()}
    return s.map(table).fillna("")


def romanize(c: Column) -> Column:
    """``to_ascii`` over Arrow batches, each distinct value of a batch once."""
    return F.pandas_udf(_batch, T.StringType())(c)
