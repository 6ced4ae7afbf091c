"""Retrieval cuts, features, decisions, evaluation and sources against the cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from resolvent.operators import decide as D
from resolvent.operators import evaluate as E
from resolvent.operators import features as P
from resolvent.operators import model as M
from resolvent.operators import ranking as R
from resolvent.operators import tfidf as I
from resolvent.sources import io

PAIR = "s1_id string, target_id string, prob double"


def kept(df):
    return sorted(r["target_id"] for r in df.collect())


def cands(spark, rows):
    return spark.createDataFrame([("S1", t, p) for t, p in rows], PAIR)


def test_threshold_policy(spark):
    assert kept(D.threshold_policy(cands(spark, [("S2-001", 0.35), ("S2-002", 0.28), ("S3-005", 0.12)]))) == []
    assert kept(D.threshold_policy(cands(spark, [("S2-001", 0.95), ("S2-002", 0.78), ("S3-005", 0.45)]))) == ["S2-001", "S2-002"]
    assert kept(D.threshold_policy(cands(spark, [("S2-001", 0.88), ("S2-002", 0.55)]))) == ["S2-001"]


def test_engine(spark):
    assert kept(D.full_engine(cands(spark, [("S2-001", 0.30), ("S2-002", 0.25)]))) == []
    assert kept(D.full_engine(cands(spark, [("S2-001", 0.80), ("S3-001", 0.73)]))) == ["S2-001"]
    many = [(f"S2-00{i}", 0.95 - 0.01 * i) for i in range(8)]
    assert len(kept(D.full_engine(cands(spark, many)))) <= 5
    assert kept(D.full_engine(cands(spark, many), legacy=True)) == ["S2-000"]


def test_expected_f(spark):
    rows = [("a", 0.95), ("b", 0.90), ("c", 0.85), ("d", 0.80)]
    assert kept(D.expected_f_select(cands(spark, rows))) == ["a", "b", "c", "d"]
    assert kept(D.expected_f_legacy(cands(spark, rows))) == ["a"]
    assert kept(D.expected_f_select(cands(spark, [("a", 0.05)]))) == []


def test_collisions(spark):
    df = spark.createDataFrame([("S1-A", "S2-M", 0.95), ("S1-B", "S2-M", 0.60), ("S1-C", "S2-N", 0.7), ("S1-D", "S2-N", 0.6)], PAIR)
    got = {(r["s1_id"], r["target_id"]) for r in D.resolve_collisions(df).collect()}
    assert got == {("S1-A", "S2-M"), ("S1-C", "S2-N"), ("S1-D", "S2-N")}
    owners = D.one_to_one(df).groupBy("target_id").count().collect()
    assert all(r["count"] == 1 for r in owners)


def test_macro_f05(spark):
    truth = spark.createDataFrame([("1", "S2-10"), ("1", "S3-20")], "s1_id string, target_id string")
    ids = spark.createDataFrame([("1",), ("2",)], "s1_id string")
    perfect = E.macro_f05(ids, truth, truth).first()
    assert (perfect["macro_f05"], perfect["precision"], perfect["recall"], perfect["singletons_kept"]) == (1.0, 1.0, 1.0, 1)
    truth = spark.createDataFrame([("1", "S2-00047"), ("1", "S3-00812")], "s1_id string, target_id string")
    pred = spark.createDataFrame([("1", "S2-00047"), ("1", "S2-00193"), ("1", "S3-00812")], "s1_id string, target_id string")
    assert E.per_record(ids.where("s1_id = '1'"), pred, truth).first()["f05"] == pytest.approx(0.714, abs=1e-3)
    wrong = spark.createDataFrame([("2", "S2-1")], "s1_id string, target_id string")
    assert E.per_record(ids.where("s1_id = '2'"), wrong, truth.limit(0)).first()["f05"] == 0.0
    assert E.per_record(ids.where("s1_id = '1'"), wrong.limit(0), truth).first()["f05"] == 0.0


def test_adaptive_cut(spark):
    rows = [("S1", f"S2-{i:03d}", 0.99 if i == 0 else 0.4 - 0.01 * i) for i in range(9)]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, score double")
    steep = R.adaptive_cut(df, 25).orderBy("rank").collect()
    assert len(steep) == 3 and steep[0]["target_id"] == "S2-000"
    flat = spark.createDataFrame([("S1", f"S2-{i:03d}", 0.6 - 0.001 * i) for i in range(30)], "s1_id string, target_id string, score double")
    assert 5 < R.adaptive_cut(flat, 25).count() <= 25


def test_retrieval_stays_in_its_partition_and_recall_grows(spark):
    q = spark.createDataFrame([("a", "US", "target store"), ("b", "FR", "cafe paris")], "s1_id string, country string, t string")
    t = spark.createDataFrame([("x", "US", "target store inc"), ("y", "FR", "target store"), ("z", "FR", "cafe de paris"), ("w", "US", "oak venture")], "target_id string, country string, t string")
    words = F.split("t", " ")
    got = I.retrieve(q, t, words, words, ["country"], k=5).collect()
    assert {(r["s1_id"], r["target_id"]) for r in got} == {("a", "x"), ("b", "z")}
    cand = spark.createDataFrame(got, I.retrieve(q, t, words, words, ["country"], k=5).schema)
    truth = spark.createDataFrame([("a", "x"), ("b", "z")], "s1_id string, target_id string")
    recall = [r["recall"] for r in E.recall_at(cand, truth, [1, 2, 3]).orderBy("k").collect()]
    assert recall == sorted(recall) and recall[-1] == 1.0


def test_features(spark):
    cols = "target_id string, name_a string, addr_a string, postal_a string, house_a string, country_a string, name_b string, addr_b string, postal_b string, house_b string, country_b string"
    rows = [
        ("S2-1", "xyz corp", "500 broadway new york", "", "500", "US", "xyz corp", "500 broadway suite 2 new york", "", "500", "US"),
        ("S2-2", "xyz corp", "500 broadway new york", "", "500", "US", "xyz corp", "900 broadway new york", "", "900", "US"),
        ("S3-200", "apple computer", "1 infinite loop", "", "1", "US", "apple computer inc", "1 infinite loop cupertino", "", "1", "US"),
        ("S2-3", "apple store", "", "", "", "US", "apple store", "", "", "", "US"),
    ]
    got = {r["target_id"]: r for r in P.with_features(spark.createDataFrame(rows, cols)).collect()}
    assert got["S2-1"]["house_num_match"] == 1 and got["S2-2"]["house_num_match"] == 0
    apple = got["S3-200"]
    assert apple["name_containment"] == 1 and apple["target_source_s3"] == 1 and apple["first_token_match"] == 1 and apple["cross_prod"] > 0 and apple["name_char3_cos"] > 0.5
    assert got["S2-3"]["both_addr_present"] == 0 and got["S2-3"]["addr_missing"] == 1 and got["S2-3"]["name_x_addr_missing"] > 0.9


def test_sources(spark, tmp_path):
    path = f"file://{tmp_path}/s.tsv"
    rows = [("S1-1", 'A "quoted" name', "1 Rd, X", "US"), ("S1-2", "B", None, "FR")]
    io.write_tsv(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"), path)
    got = {r["entity_id"]: r for r in io.scan_source(spark, path).collect()}
    assert got["S1-1"]["business_name"] == 'A "quoted" name' and got["S1-2"]["business_address"] == ""
    with pytest.raises(ValueError, match="country"):
        io.require(spark.range(1).selectExpr("id as entity_id"), ["entity_id", "country"])
    lists = io.id_lists(spark.createDataFrame([("1",), ("2",)], "s1_id string"), spark.createDataFrame([("1", "b"), ("1", "a")], "s1_id string, target_id string"))
    assert {r["source1_entity_id"]: r["matched_entity_ids"] for r in lists.collect()} == {"1": "a,b", "2": ""}
    assert E.output_contract(spark.createDataFrame([("1",)], "s1_id string"), spark.createDataFrame([("1", "a")], "s1_id string, target_id string"), spark.createDataFrame([("1", "a")], "s1_id string, target_id string")).agg(F.sum("bad")).first()[0] == 0


def test_out_of_fold_sees_no_pair_of_its_record(spark):
    df = spark.createDataFrame([(f"r{i // 3}", f"t{i}", float(i % 3), int(i % 3 == 2)) for i in range(90)], "s1_id string, target_id string, x double, label int")
    out = M.out_of_fold(df, ["x"], M.logistic()).collect()
    assert len(out) == 90 and all(0 <= r["prob"] <= 1 for r in out)
    assert min(r["prob"] for r in out if r["label"]) > max(r["prob"] for r in out if not r["label"])
