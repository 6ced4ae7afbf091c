"""Mixing, packing and the pipeline."""

import hashlib
import math
import re

import pytest

from resolvent.llm.mixing import mix_sources
from resolvent.llm.packing import Packer, pack

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)


def test_mix_matches_a_plain_version(spark):
    rows = [(i, "w " * (i % 17), ["a", "b", None, "c", "é", "zz"][(i * i) % 6], 2.0 if i % 3 else 0.5, 1) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, "q q", "a", None, 1), (9000, None, "a", 0.0, 1)], "doc_id long, text string, source string, q double, size int")
    out = mix_sources(df, weight_col="q").collect()
    assert len(out) == len(rows) + 2
    sizes = {}
    for r in out:
        n = len(WORD.findall(r["text"] or ""))
        assert r["size"] == n and r["taken"] <= 2 * n and r["taken"] == n * r["copies"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
    goal = plain_targets(sizes)
    for s in sizes:
        mine = [r for r in out if r["source"] == s]
        assert all(abs(r["target"] - goal[s]) < 1e-6 and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - goal[s]) <= 17
        epochs = math.floor(goal[s] / sizes[s] + 1e-12) if sizes[s] else 0
        u = lambda r: (int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        key = lambda r: (-math.log(u(r)) / (r["q"] if r["q"] and r["q"] > 0 else 1.0), str(r["doc_id"]))
        run, rest = 0, goal[s] - epochs * sizes[s]
        for r in sorted(mine, key=key):
            run += r["size"]
            assert r["copies"] == epochs + (run - r["size"] / 2 <= rest)
    again = mix_sources(df.repartition(7), weight_col="q").collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in out)


def test_mix_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(df).count() == 0
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix_sources(df).collect()] == [0, 0]


def plain_best_fit(items, capacity, per_source):
    bins = []
    out = []
    for size, source, cluster in items:
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and b["room"] > 0 and cluster not in b["clusters"] and b["sources"].count(source) < per_source]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"room": capacity, "clusters": [], "sources": []})
            i = len(bins) - 1
        b = bins[i]
        out.append((i, capacity - b["room"], len(b["clusters"])))
        b["room"] -= size
        b["clusters"].append(cluster)
        b["sources"].append(source)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packer_finds_the_tightest_bin(seed):
    import random

    rng = random.Random(seed)
    items = [(rng.randrange(0, 60), rng.randrange(3), rng.randrange(30)) for _ in range(300)]
    p = Packer(100, 2)
    assert [p.add(*x) for x in items] == plain_best_fit(items, 100, 2)


def test_pack(spark):
    rows = [(i, "w " * ((i * 37) % 130), f"s{i % 3}" if i % 11 else None, 5) for i in range(300)] + [(i, "copy " * 10, "s0", 5) for i in range(300, 320)]
    rows += [(400, None, "s1", 5), (401, "x " * 1000, "s1", 5), (402, "w", "s1", 5), (402, "w", "s1", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id int")
    out = pack(df, capacity=128, per_source=2, shard=100).collect()
    words, bins = {}, {}
    for r in out:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
        bins.setdefault(r["bin_id"], []).append(r)
    want = {}
    for i, t, *_ in rows:
        want[i] = want.get(i, 0) + len((t or "").split())
    assert words == want
    for held in bins.values():
        held.sort(key=lambda r: r["position"])
        assert sum(r["n_words"] for r in held) <= 128
        assert len({r["cluster"] for r in held}) == len(held)
        assert max(sum(x["source"] == r["source"] for x in held) for r in held) <= 2
        at = 0
        for r in held:
            assert r["start"] == at
            at += r["n_words"]
    assert pack(df.limit(0)).count() == 0


def test_pack_keeps_ids_beside_null_ones(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a b", "s"), (None, "c", "s"), (-5, "d e f", None)], "doc_id long, text string, source string")
    assert sorted(((r["doc_id"], r["n_words"]) for r in pack(df).collect()), key=str) == sorted([(big, 2), (None, 1), (-5, 3)], key=str)


def text_of(n, words=60):
    return " ".join(f"t{n}w{i}" for i in range(words))


def test_join_stage_loses_no_document(spark):
    import corpus_pipeline as c

    rows = [(None, text_of(1), "a"), (None, text_of(2), "a"), (None, text_of(3), "a"), (5, text_of(4), "a"), (5, text_of(5), "a"), (6, text_of(6), "a")]
    schema = "doc_id long, text string, component_id string"
    assert sorted(map(tuple, c.ngram_join(spark, spark.createDataFrame(rows, schema), "").collect()), key=str) == sorted(rows, key=str)
    more = [(5, text_of(4), "b"), (5, text_of(4), "a"), (9, text_of(6), "a"), (None, None, "a"), (None, None, "a"), (7, "", "a"), (None, text_of(2) + " x", "a")]
    got = [tuple(r) for r in c.ngram_join(spark, spark.createDataFrame(rows + more, schema), "").collect()]
    texts = [t for _, t, _ in got if t]
    near = [t for t in texts if t.startswith(text_of(2))]
    assert len(texts) == 6 and len(near) == 1 and len(got) == 9
    assert {t for t in texts if t not in near} == {text_of(n) for n in (1, 3, 4, 5, 6)}
    assert [x for x in got if x[1] == text_of(4)] == [(5, text_of(4), "a")]
    assert c.ngram_join(spark, spark.createDataFrame([], schema), "").count() == 0


def test_stages_leave_other_columns_alone(spark, tmp_path):
    import corpus_pipeline as c

    names = ["size", "source_size", "target", "copies", "taken", "dropped_lines", "log_weight", "gumbel_key", "kept"]
    rows = [(i, text_of(i, 80), "ab"[i % 2], *[100 * i + j for j in range(len(names))]) for i in range(12)]
    rows += [(None, None, None, *range(9)), (3, rows[3][1], "b", *[7] * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = {tuple(r) for r in out.collect()}
        if name == "line_dedup":
            got = {(r[0], *r[2:]) for r in got}
            assert got <= {(r[0], *r[2:]) for r in rows}, name
        else:
            assert got and got <= set(rows), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline(spark):
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality_classifier", "line_dedup", "ngram_join", "source_mix", "best_fit_packing"]
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows
        docs = spark.createDataFrame(rows, docs.schema)
    last = c.STAGES[-1][1](spark, docs, d)
    assert "doc_id" in last.columns and last.count() >= docs.select("doc_id").distinct().count()
