"""Retrieval of short texts inside tasks gives what the join of terms gives."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from resolvent.functions import text as X
from resolvent.operators import short_texts
from resolvent.operators import tfidf as I

GRAMS = lambda: X.padded_grams(F.col("t"), 3, 4)


def records(spark, seed, name, n):
    rng = random.Random(seed)
    part = lambda: rng.choice(["old", "plate", "café", "straße 12", "brand#7", "110034", "110035", "z"])
    rows = [(f"{name}-{i}", rng.choice(["US", "US", "FR", None]), rng.choice(["", None, " ".join(part() for _ in range(rng.randrange(1, 4)))])) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} string, country string, t string")


@pytest.mark.parametrize("more", [{}, {"top": 3}, {"joint": True, "max_df": 0.5}, {"max_df": 0.25, "least": 0.3}, {"keys": []}, {"max_features": 12}])
def test_same_as_joined_terms(spark, monkeypatch, more):
    monkeypatch.setattr(short_texts, "QUERIES", 15)
    monkeypatch.setattr(short_texts, "TARGETS", 20)
    q, t = records(spark, 1, "s1_id", 60), records(spark, 2, "target_id", 150)
    more = {"keys": ["country"], "k": 4, **more}
    rows = [sorted((r["s1_id"], r["target_id"], round(r["score"], 8), r["rank"]) for r in I.retrieve(q, t, GRAMS(), GRAMS(), short=short, **more).collect()) for short in (False, True)]
    assert rows[0] == rows[1] and rows[0]


def test_repeated_ids_and_large_vocabularies_are_joined(spark, monkeypatch):
    q, t = records(spark, 1, "s1_id", 30), records(spark, 2, "target_id", 40)
    get = lambda q, short: sorted(map(tuple, I.retrieve(q, t, GRAMS(), GRAMS(), ["country"], k=3, short=short).collect()))
    assert get(q.union(q), True) == get(q.union(q), False)
    monkeypatch.setattr(short_texts, "VOCABULARY", 2)
    assert get(q, True) == get(q, False)


def test_terms_do_not_meet_in_a_join(spark):
    q, t = records(spark, 1, "s1_id", 30), records(spark, 2, "target_id", 40)
    plan = I.retrieve(q, t, GRAMS(), GRAMS(), ["country"], k=3, short=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "term" not in plan
    joined = I.retrieve(q, t, GRAMS(), GRAMS(), ["country"], k=3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in joined  # a record becomes many terms


@pytest.mark.parametrize(("least", "many"), [(0.3, 2000), (0.3, 20), (0.0, 20), (0.6, 20)])
def test_bounds_leave_out_long_lists_and_no_target(monkeypatch, least, many):
    monkeypatch.setattr(short_texts, "MANY", many)
    rng, n = np.random.default_rng(5), 600
    rare = lambda: rng.integers(40, n, rng.integers(0, 3))
    vec = lambda: np.sort(np.concatenate([rng.integers(0, 4, 2), rng.integers(4, 40, 1), rare()])).astype(np.int32).tobytes()
    side = lambda name, rows: pd.DataFrame({"key": 0, "vec": sorted({vec() for _ in range(rows)})}).assign(g=lambda x: [f"{name}{i}" for i in range(len(x))])
    q, t = side("q", 300), side("t", 3000)
    idf = np.concatenate([np.full(4, 1.3), np.full(36, 4.0), np.full(n - 40, 7.0)])

    def dense(vecs):
        out = np.zeros((len(vecs), n))
        for i, v in enumerate(vecs):
            place, tf = np.unique(np.frombuffer(v, np.int32), return_counts=True)
            out[i, place] = (1 + np.log(tf)) * idf[place]
        return out / np.linalg.norm(out, axis=1)[:, None]

    scores = np.round(dense(q["vec"]) @ dense(t["vec"]).T, 9)
    want = [(g, t["g"][j], scores[i, j]) for i, g in enumerate(q["g"]) for j in sorted(range(len(t)), key=lambda j: (-scores[i, j], t["g"][j]))[:7] if scores[i, j] > least]
    got = short_texts._scorer(SimpleNamespace(value=[("", None, idf)]), 7, least)(q, t)
    assert [x[:2] for x in got.itertuples(index=False, name=None)] == [x[:2] for x in want]
    assert np.allclose(got["score"], [x[2] for x in want], atol=2e-9)
    row, place, w, _ = short_texts._vectors(q["vec"], idf)
    block = short_texts._Block(t["vec"], idf)
    _, a, b, _ = block.needed(row, place, w, 0.3)
    starts, ends = block.lists(place)
    assert (b - a).sum() < (ends - starts).sum() / 3
