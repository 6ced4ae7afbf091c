"""Text functions against the vectors of FIXTURES.md."""

import time

import pytest
from pyspark.sql import functions as F

from resolvent.functions import similarity as S
from resolvent.functions import text as X


def one(spark, build, *values):
    cols = [F.lit(v) for v in values]
    return spark.range(1).select(build(*cols).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Apple Incorporated", "apple inc"), ("Google LLC", "google llc"), ("General Electric Corporation", "general electric corp"), ("Infosys Private Limited", "infosys pvt ltd"),
        ("Wipro Limited", "wipro ltd"), ("Tata Consultancy Services LLP", "tata consultancy services llp"), ("Apple Co", "apple"), ("Apple Company", "apple co"),
        ("Apex Corp dba Apex Logistics", "apex logistics"), ("Metro Foods c/o Central Distributors", "central distributors"), ("", ""), (None, ""),
    ],
)
def test_business_name(spark, name, want):
    assert one(spark, X.business_name, name) == want


def test_names_with_marks_and_aliases(spark):
    got = one(spark, X.business_name, "Café & Résumé Société par Actions Simplifiée")
    assert "cafe" in got and "resume" in got and got.endswith("sas")
    got = one(spark, X.business_name, "Shree Laxmi Vidya Pith")
    assert "sri" in got and "lakshmi" in got
    assert one(spark, X.dba_and_domain, "http://www.cool-gadgets.com") == "cool gadgets"
    assert one(spark, X.dba_and_domain, "Apple Co") == "apple co"  # strict: a bare co is no marker


def test_views(spark):
    assert one(spark, X.fold, "Crème Brûlée") == "Creme Brulee"
    assert one(spark, X.token_normalize, "Hello, World! #123") == "hello world 123"
    assert one(spark, X.compact, "Target Corporation Store") == "targetcorporationstore"
    long = one(spark, X.address_long, "123 Main St, Apt 4B, MG Rd, 5th Ave").split()
    assert {"street", "apartment", "road", "avenue"} <= set(long)
    for raw, want in (("US", "US"), ("India", "INDIA"), ("France", "FRANCE")):
        assert one(spark, X.country, raw) == want


def test_phonetic_skeletons_agree(spark):
    assert one(spark, X.phonetic_skeleton, "Lakshmi Jewellers") == one(spark, X.phonetic_skeleton, "Laxmi Jewelers") == "lksm jwlrs"


def test_numbers(spark):
    t = F.array(*[F.lit(x) for x in ("123", "mg", "road", "bengaluru", "560001")])
    row = spark.range(1).select(X.house_from_tokens(t).alias("h"), X.postal_from_tokens(t).alias("p"), X.numeric_tokens(t).alias("n")).first()
    assert (row["h"], row["p"], row["n"]) == ("123", "560001", ["123", "560001"])


def test_record(spark):
    df = spark.createDataFrame([("S1-999", "Google, LLC", "1600 Amphitheatre Pkwy, Mountain View, CA", "US")], "entity_id string, business_name string, business_address string, country string")
    r = X.record_views(df).first()
    assert r["norm_name"] == "google llc" and r["compact_name"] == "googlellc" and "parkway" in r["norm_addr"] and r["country_key"] == "US"


def test_string_metrics():
    assert S.jaro_winkler_one("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler_one("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert S.jaro_winkler_one("", "") == 0.0 and S.jaro_winkler_one("a", "a") == 1.0
    assert S.lcs_length("kitten", "sitting") == 4 and S.indel_ratio("", "") == 1.0
    assert S.token_sort_ratio("b a", "a b") == 1.0 and S.token_set_ratio("a b c", "a b") == 1.0 and S.partial_ratio("bcd", "abcde") == 1.0


def test_romanizer():
    from resolvent.functions.romanize import to_ascii

    assert to_ascii("लक्ष्मी") == "lakshmee" and to_ascii("राम") == "raam" and to_ascii("१२३") == "123"
    assert to_ascii("Café ß") == "Cafe ss" and to_ascii(None) == ""
    assert to_ascii("संपत") == "sampat" and to_ascii("ಕಮಲ") == "kamal"


def test_number_relations(spark):
    from resolvent.functions import keys as Y

    cases = [(["1"], ["1"], "equal"), (["1"], ["1", "2"], "subset"), (["1", "2"], ["1"], "superset"), (["1", "2"], ["1", "3"], "overlap"), ([], ["1"], "missing left"), ([], [], "none"), (["123"], ["124"], "near"), (["12"], ["512"], "part"), (["11"], ["999"], "different")]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", Y.number_relation(F.col("a"), F.col("b"))).collect())
    row = spark.createDataFrame([(["100", "7"], ["103", "9000"])], "a array<string>, b array<string>").select(Y.closest_delta(F.col("a"), F.col("b")).alias("d")).first()
    assert row["d"] == 3


def test_edit_classes():
    for a, b, want in (("cat", "cut", "sub:a>u"), ("cat", "cats", "ins:s"), ("cats", "cat", "del:s"), ("form", "from", "swap:or"), ("a", "a", ""), ("abc", "xyz", ""), ("", "x", "ins:x")):
        assert S.edit_class(a, b) == want


def test_grams_of_long_texts_take_linear_time(spark):
    def want(t, n):
        return sorted({t[i : i + n] for i in range(max(1, len(t) - n + 1))}) if t else []

    texts = ["", "ab", "abcde", "né😀xyzw", "ab" * 130 + "c", "x" * 259, "xy" * 130 + "😀", *("".join(chr(97 + (i * i + k) % 23) for i in range(k)) for k in range(250, 265)), *("0123456789" * 52)[:520].split("9")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.char_grams(F.col("t"), 5).alias("g")).collect()
    assert all(sorted(r["g"]) == want(r["t"], 5) for r in rows)
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.hex(i)), "").alias("t"))
    began = time.time()
    assert long.select(F.size(X.char_grams(F.col("t"), 5))).first()[0] > 10_000
    assert time.time() - began < 10
