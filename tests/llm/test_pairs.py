"""The join, line dedup and embedding operators against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from resolvent.llm import _vec
from resolvent.llm._graph import components
from resolvent.llm._scratch import Scratch
from resolvent.llm.embedding_dedup import learn_code, similar_vectors
from resolvent.llm.line_dedup import _runs, dedup_lines, op7_line_dedup, shingles, signatures
from resolvent.llm.ngram_join import _apart, _boundary, _marks, _prefix, ngram_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def roots(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def brute_join(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in roots(ids, links).items()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ß", "A", "Zz"]
    passage = [rng.choice(vocab) for _ in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 8, 9, 12, 30, 80, 200]))] for _ in range(n)]
    docs = [" ".join(b) for b in base]
    for b in base[: n // 2]:  # near copies at all distances from the threshold
        for edits in (0, 1, 2, 3):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            docs.append("\t".join(c) if edits == 0 else "\n".join(c))
    docs += [" ".join([rng.choice(vocab) for _ in range(rng.randrange(10, 90))] + passage) for _ in range(40)]
    hot = [rng.choice(vocab) for _ in range(120)]
    for _ in range(40):  # a list long enough to be contracted
        c = list(hot)
        for _ in range(rng.randrange(6)):
            c[rng.randrange(len(c))] = rng.choice(vocab)
        docs.append(" ".join(c))
    docs += [None, "", "  \n", "one", "ONE", "x " * 3000]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, id int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(df).collect()}
    assert got == brute_join(rows)


def test_join_finds_texts_held_in_longer_ones(spark):
    rng = random.Random(5)
    rows = []
    for n, (short, long) in enumerate([(77, 100), (80, 100), (30, 38), (75, 100)] * 15):  # shingles; no pair shares a word with another
        words = [f"p{n}w{rng.randrange(10**6)}" for _ in range(long + 4)]
        at = rng.randrange(long - short + 1)
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[at : at + short + 4]))]
    rows += [(1000 + n, " ".join(f"f{n}w{i}" for i in range(10_000))) for n in range(30)]  # lists are short, so the pairs are heavy
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_join(rows)


def test_join_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_components(none).count() == 0
    text = "a b c d e f g h"
    df = spark.createDataFrame([(5, text), (5, text), (3, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_components(df).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (None, None)], key=str)


def test_marks_differ_no_more_than_sets():
    rng = np.random.default_rng(5)
    for n, m, both in [(1, 1, 1), (1, 1, 0), (63, 64, 40), (65, 64, 60), (400, 420, 390), (400, 300, 50), (5000, 3900, 3800)]:
        all_ = rng.integers(0, 1 << 63, n + m, np.int64).view(np.uint64)
        x, y = np.sort(all_[:n]), np.sort(np.r_[all_[:both], all_[n : n + m - both]])
        a, b = (np.frombuffer(_marks(v), np.uint64) for v in (x, y))
        assert _apart(a, b) == _apart(b, a) <= n + m - 2 * both
        if both == n == m:
            assert _apart(a, b) == 0
    assert _apart(*(np.frombuffer(_marks(v), np.uint64) for v in (all_[:400], all_[4000:4400]))) > 800 - 2 * ((3 * 800 + 6) // 7)


def test_prefix_and_boundary():
    for n in range(1, 60):
        assert _prefix(n) == n - math.ceil(0.75 * n) + 1
    assert _boundary([(10, 5), (40, 5)], 0.0) <= _boundary([(10, 5), (40, 5)], 50.0)


def test_words_like_the_pattern():
    import pyarrow as pa

    texts = ["a b", "", " x", None, "é\x0bü  ", "tail", "\n", "q\tr\rs"]
    for _, raw, offs in _vec.chunks(pa.array(texts)):
        s, e, r = _vec.cut_words(raw, offs)
        got = [(int(row), raw[a:b].tobytes().decode()) for a, b, row in zip(s, e, r)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    h = _vec.span_hash(np.frombuffer(b"ab cd ab", np.uint8), np.array([0, 3, 6]), np.array([2, 5, 8]))
    assert h[0] == h[2] != h[1]


def test_components_match_brute_force(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (5000, 5000)]
    want = roots({x for ab in links for x in ab}, links)
    got = components(spark, spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == want
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def line_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randrange(2, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(8, 30)))
    pool = [line() for _ in range(12)]
    docs = []
    for _ in range(40):
        ls = [line() for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool).split(" ")
            if rng.random() < 0.6:
                p[rng.randrange(len(p))] = word()
            ls.insert(rng.randrange(len(ls) + 1), " ".join(p))
        docs.append("\n".join(ls + ["short"] * rng.randrange(2)))
    return list(enumerate(docs)) + [(900, None), (901, ""), (902, "\n\n"), (903, docs[0])]


def brute_lines(rows, shortest=32, k=5, percent=75):
    lines = [(i, n, x) for i, t in sorted(rows, key=lambda r: r[0]) for n, x in enumerate((t or "").split("\n")) if len(x) >= shortest]
    sets = [shingles(x, k) for _, _, x in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(range(len(lines)), links)
    gone = {lines[a][:2] for a in range(len(lines)) if root[a] != a}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_line_dedup_matches_brute_force(spark):
    rows = line_corpus(3)
    df = spark.createDataFrame([(i, t, "z", 9) for i, t in rows], "doc_id long, text string, id string, dropped_lines int")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "id", "dropped_lines"]
    got, want = {r["doc_id"]: r["text"] for r in out.collect()}, brute_lines(rows)
    same = sum(got[i] == want[i] for i in want)
    assert same >= 0.97 * len(want) and set(got) == set(want)  # bands may miss a few links near the threshold
    assert got[903] == "" or got[903] == want[903]


def test_line_dedup_tests_all_pairs_of_a_bucket(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(n))
    frame, lines = word(240), []
    for _ in range(300):  # one template with a changing part: strangers are under the threshold, partners well over it
        part = word(48)
        lines += [frame + part, frame + part[:-18] + word(18)]
    a, b, c = (shingles(x, 5) for x in (lines[0], lines[1], lines[2]))
    assert len(a & c) / len(a | c) < 0.75 <= len(a & b) / len(a | b)
    rng.shuffle(lines)
    out = dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert out.where("dropped_lines = 1").count() >= 298  # partners share a bucket but for a few in a thousand


def families(seed, n=100, kinds=4):
    """``kinds`` families of ``n`` near copies of one line each, at all distances up to about the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randrange(2, 9)))
    rows = []
    for _ in range(kinds):
        frame = [word() for _ in range(40)]
        for _ in range(n):
            line = list(frame)
            for _ in range(rng.randrange(5)):
                line[rng.randrange(len(line))] = word()
            rows.append(" ".join(line))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_line_dedup_does_not_depend_on_the_layout_or_on_blocks(spark):
    rows = families(2)
    want = {i for i, t in brute_lines(rows).items() if t == ""}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [
        {r["doc_id"] for r in dedup_lines(df.repartition(n), block=b).where("text = ''").collect()}
        for n, b in ((1, 1000), (8, 1000), (48, 1000), (5, 30))
    ]
    assert got[0] == got[1] == got[2] == got[3]
    assert len(got[0] & want) >= 0.99 * len(want) and got[0] <= want


def test_runs_cut_sorted_batches():
    import pyarrow as pa

    rng = random.Random(3)
    for _ in range(30):
        keys = sorted(rng.choice([1, 2, 3, 4, 5, 5, 5, 5]) for _ in range(rng.randrange(0, 60)))
        rows = [(k, rng.randrange(3)) for k in keys]
        rows.sort()
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(5))
        batches = [pa.RecordBatch.from_pydict({"k": pa.array([r[0] for r in rows[a:b]], pa.int64()), "v": pa.array([r[1] for r in rows[a:b]], pa.int64())}) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        got, pieces = [], []
        for cols, piece in _runs(batches, 7):
            got += [tuple(r.values()) for r in cols.to_pylist()]
            here = set(cols.column(0).to_pylist())
            assert piece is None or len(here) == 1 and cols.num_rows <= 7
            if piece is None:
                assert not here & {k for k, _ in pieces}
            pieces += [(k, piece) for k in here]
        assert got == rows and len(set(pieces)) == len(pieces)


def test_queries_take_short_lines(spark, tmp_path):
    import corpus_pipeline

    texts = ["see you\n\nA\n" + "long line " * 5, "see you\n\n  \nB", "  \nA\nnew é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [texts[0], "\n  \nB", "  \nnew é"]
    got = {r["doc_id"]: r["text_sha256"] for r in op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(want)}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()} == dict(enumerate(want))


def test_band_recall():
    rng = np.random.default_rng(1)
    hit = n = 0
    for _ in range(300):
        a = rng.integers(97, 122, 200)
        b = a.copy()
        b[rng.choice(200, 4, replace=False)] = 65
        ja, jb = shingles("".join(map(chr, a)), 5), shingles("".join(map(chr, b)), 5)
        if len(ja & jb) / len(ja | jb) >= 0.75:
            cp = np.r_[a, b].astype(np.uint32)
            key = signatures(cp, np.array([0, 200]), np.array([200, 400]), 5, 10, 5)
            hit, n = hit + bool((key[0] == key[1]).any()), n + 1
    assert n > 100 and hit / n >= 0.9


def test_line_dedup_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    x = spark.createDataFrame([(1, "a" * 40), (1, "a" * 40), (None, "b" * 40)], "doc_id long, text string")
    assert sorted(r["text"] for r in dedup_lines(x).collect()) == ["a" * 40, "a" * 40, "b" * 40]


def vectors(seed, n=400, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = base[:150] + rng.standard_normal((150, dim)) * rng.uniform(0.05, 0.42, (150, 1))
    hot = base[0] + 0.1 * rng.standard_normal((60, dim))
    x = np.r_[base, near, hot, base[5:8]].astype(np.float32)
    label = np.r_[np.arange(n) % 3, np.arange(150) % 3, np.zeros(60), np.arange(5, 8) % 3].astype(int)
    return [(i, [float(v) for v in row], int(lab)) for i, (row, lab) in enumerate(zip(x, label))]


def test_embeddings_recall_against_brute_force(spark):
    rows = vectors(2)
    odd = [(9001, None, 0), (9002, [0.0] * 64, 0), (9003, [float("nan")] + rows[0][1][1:], 0), (9004, [None] + rows[0][1][1:], 0), (9005, rows[0][1], None), (9006, [], 0), (9007, [1.0, 2.0], 0), (9008, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in similar_vectors(df).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :]) & ~np.eye(len(x), dtype=bool)
    want = link.sum(axis=1)
    have = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.95 * want.sum()
    root = roots(range(len(x)), np.argwhere(link).tolist())
    assert np.mean([got[i]["component_id"] == root[i] for i in root]) >= 0.97
    for i in (9001, 9002, 9003, 9004, 9005, 9006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[9008]["component_id"] == 9007 and got[9007]["n_links"] == 1


def test_short_vectors_get_full_codes():
    x = np.random.default_rng(1).standard_normal((500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, proj = learn_code(x)
    signs = (x - mean) @ proj >= 0
    assert signs.shape == (500, 64)
    assert len(np.unique(signs[:, :16] @ (1 << np.arange(16)))) > 50  # a chunk tells vectors apart


def test_embeddings_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, label int, v int"
    assert similar_vectors(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0], 1, 0), (1, [1.0, 2.0], 1, 0), (2, [2.0, 4.0], 1, 0), (3, None, 1, 0)], schema)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in similar_vectors(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_codes_with_their_neighbours_are_not_broadcast(spark, monkeypatch):
    plans, cut = {}, Scratch.cut

    def seen(self, df, name="t"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(self, df, name)

    monkeypatch.setattr(Scratch, "cut", seen)
    x = np.random.default_rng(3).standard_normal((50, 64))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.r_[x, x + 0.01])]
    got = similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r["n_links"] == 1 and r["component_id"] == r["vec_id"] % 50 for r in got)
    assert re.search(r"SortMergeJoin \[label.*chunk", plans["links"]) and not re.search(r"BroadcastHashJoin \[label.*chunk", plans["links"])
