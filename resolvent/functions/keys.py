"""Sound and skeleton keys, cleaners, state lookup and number relations as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Letter groups that sound alike, in the order they apply.
DIGRAPHS = (("chh", "c"), ("ch", "c"), ("sh", "s"), ("ph", "f"), ("bh", "b"), ("dh", "d"), ("gh", "g"), ("jh", "j"), ("kh", "k"), ("th", "t"), ("ck", "k"), ("x", "ks"), ("q", "k"), ("w", "v"), ("z", "s"))
LONG_VOWELS = (("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u"), ("ou", "u"), ("ai", "e"), ("au", "o"))


def skeleton(t: Column) -> Column:
    """Consonants of a word behind its first letter, sounds unified, repeats collapsed."""
    for a, b in DIGRAPHS:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.concat(F.substring(t, 1, 1), F.regexp_replace(t.substr(F.lit(2), F.length(t)), "[aeiouyh]", ""))
    return F.regexp_replace(t, "(.)\\1+", "$1")


def stem_key(t: Column) -> Column:
    """The skeleton of a word without its plural ending."""
    return skeleton(F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def sound_set(c: Column) -> Column:
    """Sorted distinct skeletons of a name's words of two letters or more."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(X.tokens(X.token_normalize(c)), skeleton), lambda t: F.length(t) >= 2)))


def phonetic_clean(c: Column) -> Column:
    """A name with long vowels and aspirates shortened."""
    x = X.token_normalize(c)
    for a, b in (*LONG_VOWELS, *DIGRAPHS):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, "([a-z])\\1+", "$1")


def base_clean(c: Column) -> Column:
    """Record tags, symbols for words, dotted abbreviations and apostrophes resolved."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)[\\[(]\\s*id\\s*[:#]?\\s*[0-9]+\\s*[\\])]", " ")
    for a, b in (("&", " and "), ("+", " and "), ("@", " at ")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, "(?<=\\b[A-Za-z])\\.(?=[A-Za-z]\\b)", "")
    x = F.regexp_replace(x, "['’`]", "")
    return X.token_normalize(x)


def state_code(part: Column) -> Column:
    """The state that an address component names by code or in words; null for none."""
    by_name = {v: k for k, v in X.STATES.items()}
    table = F.create_map(*[F.lit(x) for kv in {**by_name, **{k: k for k in X.STATES}}.items() for x in kv])
    return F.try_element_at(table, X.token_normalize(part))


def parsed_address(c: Column) -> Column:
    """A struct of an address's numbers, its words without stop words and numbers, and its state."""
    words = X.tokens(X.address_long(c))
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), state_code)
    return F.struct(
        F.filter(words, lambda t: t.rlike("^[0-9]+$")).alias("numbers"), F.filter(words, lambda t: ~t.rlike("^[0-9]") & ~t.isin(*X.STOPWORDS)).alias("words"),
        F.try_element_at(F.filter(parts, lambda s: s.isNotNull()), F.lit(-1)).alias("state"),
    )


def number_relation(a: Column, b: Column) -> Column:
    """How two arrays of number strings stand to each other, as one of nine classes."""
    both, less, more = F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a)
    near = F.exists(less, lambda x: F.exists(more, lambda y: F.levenshtein(x, y) <= 1))
    part = F.exists(less, lambda x: F.exists(more, lambda y: x.contains(y) | y.contains(x)))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), "none").when(F.size(a) == 0, "missing left").when(F.size(b) == 0, "missing right")
        .when((F.size(less) == 0) & (F.size(more) == 0), "equal").when(F.size(less) == 0, "subset").when(F.size(more) == 0, "superset")
        .when(F.size(both) > 0, "overlap").when(part, "part").when(near, "near").otherwise("different")
    )


def closest_delta(a: Column, b: Column) -> Column:
    """b - a of the closest two numbers of equal length; null for none."""
    deltas = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: F.length(y) == F.length(x)), lambda y: y.try_cast("bigint") - x.try_cast("bigint"))))
    return F.array_min(F.transform(F.filter(deltas, lambda d: d.isNotNull()), lambda d: F.struct(F.abs(d).alias("size"), d.alias("d"))))["d"]
