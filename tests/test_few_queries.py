"""Retrieval for few queries, scored text by text, gives what the join of terms gives."""

import random

import pytest
from pyspark.sql import functions as F

from resolvent.functions import text as X
from resolvent.operators import few_queries
from resolvent.operators import tfidf as I

WORDS = lambda: F.filter(F.split("t", " "), lambda t: t != "")
GRAMS = lambda: X.char_grams(F.col("t"), 5)


def texts(spark, seed, name, n, kind, more=()):
    rng = random.Random(seed)
    part = lambda: rng.choice(["old", "plate", "cafe", "street 12", "brand_7", f"n{rng.randrange(60)}", "abcdefgh", "z"])
    rows = [rng.choice(["", None, "abc", " ".join(part() for _ in range(rng.randrange(1, 12)))]) for _ in range(n)] + list(more)
    return spark.createDataFrame([(i if kind == "long" else f"{name}-{i}", t) for i, t in enumerate(rows)], f"{name} {kind}, t string")


@pytest.mark.parametrize(("n", "kind", "more"), [(None, "long", {"min_df": 2}), (None, "string", {"least": 0.3}), (5, "long", {"max_df": 0.2, "least": 0.1}), (5, "string", {})])
def test_same_as_joined_terms(spark, monkeypatch, n, kind, more):
    for name, value in (("CHARACTERS", 400), ("CELLS", 300), ("COUNTS", 40)):
        monkeypatch.setattr(few_queries, name, value)
    q, t = texts(spark, 1, "s1_id", 30, kind), texts(spark, 2, "target_id", 200, kind)
    terms = WORDS if n is None else GRAMS
    rows = [sorted((r["s1_id"], r["target_id"], round(r["score"], 8), r["rank"]) for r in I.retrieve(q, t, terms(), terms(), k=4, few=few, **more).collect()) for few in (None, ("t", n))]
    assert rows[0] == rows[1] and rows[0]
    plan = I.retrieve(q, t, terms(), terms(), k=4, few=("t", n), **more)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no row for each term of a text


def test_other_characters_are_joined(spark):
    q, t = texts(spark, 1, "s1_id", 5, "long"), texts(spark, 2, "target_id", 20, "long", ["café plate", "old plate"])
    get = lambda few: sorted(map(tuple, I.retrieve(q, t, GRAMS(), GRAMS(), k=3, few=few).select("s1_id", "target_id", "rank").collect()))
    assert get(("t", 5)) == get(None)


def test_words_of_several_slices_are_looked_up_together(monkeypatch):
    import numpy as np
    import pyarrow as pa

    calls, places = [], few_queries._places
    monkeypatch.setattr(few_queries, "CHARACTERS", 30)
    monkeypatch.setattr(few_queries, "_places", lambda t, of: calls.append(len(t)) or places(t, of))
    assert few_queries.WORDS > 2_000_000  # check_l has 1,047,276 words of two texts or more
    shared = type("B", (), {"value": {"ids": pa.array([7]), "asked": pa.array(["a", "b"]), "at": np.array([0, 1, 2]), "query": np.array([0, 0]), "w": np.array([0.6, 0.8]), "terms": pa.array(["a", "b"]), "idf": np.array([2.0, 2.0]), "once": 0.0}})
    texts = ["b"] + [f"a b filler{i} filler" for i in range(40)] + ["a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(42)), pa.array(texts)], names=["id", "t"])
    out = list(few_queries._scorer(shared, None, 3, 0.0, (pa.int64(), pa.int64()))([batch]))[0].to_pydict()
    assert out["t"] == [1, 2, 3] and np.allclose(out["score"], 1.4 / 2**0.5)
    assert len(calls) <= 2 * -(-42 // few_queries.TOGETHER)
