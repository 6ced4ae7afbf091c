"""Registered queries of the text functions (STR) and projections (PRJ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from . import adapters as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

ALL = f"with {A.RECORDS}, r as (select * from s1 union all select * from targets)"


def every(spark, d):
    return A.s1(spark, d).unionByName(A.targets(spark, d))


def view(name: str, build, sql: str | None, column: str = "value") -> None:
    """A query that shows one function on all records, and its oracle."""
    QUERIES[name] = lambda spark, d: every(spark, d).select("entity_id", build().alias(column))
    if sql is not None:
        ORACLES[name] = f"{ALL} select entity_id, {sql} as {column} from r"


NAME, ADDR = lambda: F.col("business_name"), lambda: F.col("business_address")

# The SQL counterparts, built up from small pieces.
_Q = lambda words: "[" + ",".join(f"'{w}'" for w in words) + "]"


def s_fold(x):
    return f"replace(replace(replace(translate(coalesce({x}, ''), '{X.FOLD_FROM}', '{X.FOLD_TO}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"


def s_squeeze(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def s_clean(x):
    return f"case when lower(trim(coalesce({x}, ''))) in ('none', 'null', 'nan', '') then '' else trim(coalesce({x}, '')) end"


def s_token(x):
    return s_squeeze(f"regexp_replace(lower({s_fold(x)}), '[^a-z0-9_\\s]', ' ', 'g')")


def s_trans(x):
    return s_squeeze(f"regexp_replace(replace(lower({s_fold(s_clean(x))}), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g')")


def s_tokens(x):
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def s_sorted(x):
    return f"list_sort(list_distinct({x}))"


def s_words(x, table):
    cases = " ".join(f"when '{a}' then '{b}'" for a, b in table.items())
    return f"array_to_string(list_transform({s_tokens(x)}, lambda t: case t {cases} else t end), ' ')"


def s_legal(x):
    out = s_trans(x)
    for phrases, short in X.LEGAL_FORMS:
        out = f"regexp_replace({out}, '\\b({phrases})\\b', '{short}', 'g')"
    return s_squeeze(out)


def s_suffix(x):
    whens = "".join(f" when v like '% {p}' then substr(v, 1, length(v) - {len(p)}) || '{s}' when v = '{p}' then '{s}'" for p, s in sorted(X.LEGAL_SUFFIXES.items(), key=lambda kv: -len(kv[0])))
    return f"(select trim(case{whens} else v end) from (select {x} as v))"


def s_dba(x):
    """The legacy form; RE2 has all it needs."""
    f = s_fold(x)
    core = f"(select case when regexp_extract(v, '(?i){X.DOMAIN}', 3) <> '' then regexp_replace(v, '(?i){X.DOMAIN}', replace(regexp_extract(v, '(?i){X.DOMAIN}', 3), '-', ' '), 'g') else v end from (select {f} as v))"
    parts = f"(select regexp_split_to_array(v2, '(?i){X.DBA}') from (select {core} as v2))"
    last, first = s_token("p[-1]"), s_token("p[1]")
    return f"(select case when len(p) > 1 then case when length({last}) >= 4 then {last} else {first} end else {s_token('p[1]')} end from (select {parts} as p))"


def s_business(x):
    return s_suffix(s_words(s_dba(x), X.NAME_ALIASES))


ONE_WORD_ADDR = s_words(s_token("business_address"), X.ADDRESS_LONG)
EVERY_LEGAL = "|".join(p for p, _ in X.LEGAL_FORMS)
LEGAL_WORDS = sorted({w for p, s in X.LEGAL_FORMS for x in (*p.split("|"), s) for w in x.split(" ")})

view("str_01_clean_missing", lambda: X.clean_missing(ADDR()), s_clean("business_address"))
view("str_02_fold_latin", lambda: X.fold(NAME()), s_fold("business_name"))
view("str_03_light", lambda: X.light(NAME()), s_squeeze(f"lower({s_fold('business_name')})"))
view("str_04_light_and", lambda: X.light_and(NAME()), s_trans("business_name"))
view("str_05_token_normalize", lambda: X.token_normalize(NAME()), s_token("business_name"))
view("str_06_sorted_tokens", lambda: X.sorted_tokens(NAME()), f"array_to_string({s_sorted(s_tokens(s_token('business_name')))}, ' ')")
view("str_07_compact", lambda: X.compact(NAME()), f"replace({s_token('business_name')}, ' ', '')")
view("str_07b_compact_alnum", lambda: X.compact_alnum(NAME()), f"regexp_replace(lower({s_fold('business_name')}), '[^a-z0-9]', '', 'g')")
view("str_10_legal_canonical", lambda: X.legal_canonical(NAME()), s_legal("business_name"))
view("str_11_legal_suffix", lambda: X.legal_suffix(X.token_normalize(NAME())), s_suffix(s_token("business_name")))
view("str_12_legal_removed", lambda: X.legal_removed(NAME()), s_squeeze(f"regexp_replace({s_trans('business_name')}, '\\b({EVERY_LEGAL})\\b', ' ', 'g')"))
view("str_14_name_aliases", lambda: X.name_aliases(X.token_normalize(NAME())), s_words(s_token("business_name"), X.NAME_ALIASES))
view("str_15_address_long", lambda: X.address_long(ADDR()), ONE_WORD_ADDR)
view("str_16_address_short", lambda: X.address_short(ADDR()), s_words(s_trans("business_address"), X.ADDRESS_SHORT))
view("str_17_units_removed", lambda: X.units_removed(ADDR()), s_squeeze(f"regexp_replace({s_trans('business_address')}, '\\b(suite|ste|apartment|apt|unit|floor|fl|po box)\\s+[a-z0-9]+\\b', ' ', 'g')"))
view("str_19_dba_and_domain", lambda: X.dba_and_domain(NAME(), legacy=True), None)
view("str_19b_dba_and_domain_strict", lambda: X.dba_and_domain(NAME()), None)
FIVE, SIX = (f"regexp_extract({s_clean('business_address')}, '\\b([0-9]{{{n}}})\\b', 1)" for n in (5, 6))
view("str_21_postal_by_country", lambda: X.postal_by_country(ADDR(), F.col("country")), f"case when upper(trim(country)) in ('US', 'USA', 'FRANCE', 'FR') then {FIVE} when upper(trim(country)) in ('INDIA', 'IN') then {SIX} when {SIX} <> '' then {SIX} else {FIVE} end")
view("str_22_postal_from_tokens", lambda: X.postal_from_tokens(X.tokens(X.address_long(ADDR()))), f"coalesce(list_filter({s_tokens(ONE_WORD_ADDR)}, lambda t: regexp_full_match(t, '[0-9]{{5,6}}'))[-1], '')")
view("str_23_postal_anywhere", lambda: X.postal_anywhere(ADDR()), "coalesce(list_filter(regexp_extract_all(coalesce(business_address, ''), '[0-9]+'), lambda t: length(t) between 4 and 6)[1], '')")
view("str_24_house_leading", lambda: X.house_leading(ADDR()), f"regexp_extract({s_trans('business_address')}, '^\\s*([0-9]+[a-z0-9\\-/]*)', 1)")
view("str_25_house_from_tokens", lambda: X.house_from_tokens(X.tokens(X.address_long(ADDR()))), f"coalesce(list_filter(list_slice({s_tokens(ONE_WORD_ADDR)}, 1, 6), lambda t: regexp_full_match(t, '[0-9]{{1,5}}') or (regexp_matches(t, '[0-9]') and length(t) <= 6))[1], '')")
view("str_26_house_anywhere", lambda: X.house_anywhere(ADDR()), f"regexp_extract({s_trans('business_address')}, '\\b([0-9]+[a-z]?)\\b', 1)")
view("str_27_numeric_tokens", lambda: F.array_join(X.numeric_tokens(X.tokens(X.address_long(ADDR()))), " "), f"array_to_string({s_sorted(f"list_filter({s_tokens(ONE_WORD_ADDR)}, lambda t: regexp_matches(t, '[0-9]'))")}, ' ')")
view("str_28_number_list", lambda: F.array_join(X.number_list(ADDR()), " "), "array_to_string(list_filter(regexp_extract_all(coalesce(business_address, ''), '[0-9#]+'), lambda t: regexp_matches(t, '[0-9]')), ' ')")
view("str_29_raw_tokens", lambda: F.array_join(X.raw_tokens(ADDR()), " "), f"array_to_string({s_sorted("regexp_extract_all(lower(coalesce(business_address, '')), '[a-z0-9]+')")}, ' ')")
view("str_30_country", lambda: X.country(F.col("country")), f"upper({s_token('country')})")
view("str_31_phonetic_skeleton", lambda: X.phonetic_skeleton(NAME()), None)
view("str_35_states_expanded", lambda: X.states_expanded(ADDR()), s_words(s_token("business_address"), X.STATES))
view("str_37_ocr_repaired", lambda: F.array_join(F.transform(X.tokens(X.token_normalize(ADDR())), X.ocr_repaired), " "), f"array_to_string(list_transform({s_tokens(s_token('business_address'))}, lambda t: case when regexp_matches(t, '[0-9]') and length(regexp_replace(t, '[^a-z]', '', 'g')) > length(regexp_replace(t, '[^0-9]', '', 'g')) then translate(t, '0153487', 'olseabt') else t end), ' ')")
view("str_39_prefix_keys", lambda: F.concat_ws("|", F.substring(X.compact(NAME()), 1, 8), F.right(X.compact(NAME()), F.lit(8))), f"(select left(v, 8) || '|' || right(v, 8) from (select replace({s_token('business_name')}, ' ', '') as v))")
view("str_40_full_text", lambda: F.trim(F.concat_ws(" ", X.token_normalize(NAME()), X.token_normalize(ADDR()))), f"trim({s_token('business_name')} || ' ' || {s_token('business_address')})")
FLAGS = ["n = upper(n)", "n = lower(n)", "contains(n, '&')", "contains(n, '.')", "contains(n, ',')", "contains(n, '-')", "contains(n, '''')", "contains(n, '(')", "regexp_matches(n, '[0-9]')", "contains(n, '  ')", "a = upper(a)", "a = lower(a)", "contains(a, '#')", "contains(a, ',')", "contains(a, '-')", "contains(a, '/')", "regexp_matches(a, '^[0-9]')"]
view("str_41_format_flags", lambda: X.format_flags(NAME(), ADDR()), "(select (" + " + ".join(f"case when {f} then {1 << i} else 0 end" for i, f in enumerate(FLAGS)) + ")::int from (select coalesce(business_name, '') as n, coalesce(business_address, '') as a))")
view("str_42_latin_clean", lambda: X.latin_clean(NAME()), f"case when regexp_full_match(business_name, '[\\x00-\\x7F]*') then {s_squeeze("regexp_replace(lower(business_name), '[^a-z0-9]', ' ', 'g')")} else '' end")
view("str_43_core_tokens", lambda: F.array_join(X.core_tokens(NAME()), " "), f"array_to_string({s_sorted(f"list_filter({s_tokens(s_token('business_name'))}, lambda t: not list_contains({_Q([*X.STOPWORDS, *LEGAL_WORDS])}, t))")}, ' ')")
view("str_44_strip_country", lambda: X.strip_country(NAME(), F.col("country")), None)
view("str_45_strip_components", lambda: X.strip_components(ADDR(), ("apt 1", "apt 2")), "array_to_string(list_filter(list_transform(string_split(business_address, ','), lambda t: trim(lower(t))), lambda t: t not in ('apt 1', 'apt 2', '')), ', ')")
view("str_46_initials", lambda: X.initials(NAME()), f"array_to_string(list_transform({s_tokens(s_token('business_name'))}, lambda t: substr(t, 1, 1)), '')")
view("str_47_sql_normalize", lambda: F.lower(F.trim(F.regexp_replace(NAME(), "[^a-zA-Z0-9]+", " "))), "lower(trim(regexp_replace(business_name, '[^a-zA-Z0-9]+', ' ', 'g')))")
view("str_48_regex_default", lambda: F.coalesce(F.regexp_extract(ADDR(), "\\b([0-9]{5,6})\\b", 1), F.lit("")), "coalesce(regexp_extract(business_address, '\\b([0-9]{5,6})\\b', 1), '')")
view("str_50_split_element", lambda: F.try_element_at(F.split(ADDR(), ","), F.lit(1)), "string_split(business_address, ',')[1]")
view("str_52_arithmetic", lambda: F.round(F.log10(F.length(NAME()) + 1) + F.signum(F.length(NAME()) - 20) * F.sqrt(F.length(NAME())), 9), "round(log10(length(business_name) + 1) + sign(length(business_name) - 20) * sqrt(length(business_name)), 9)")


def str_49_split_rows(spark, d):
    return every(spark, d).select("entity_id", F.explode(F.split("business_address", ",")).alias("part")).select("entity_id", F.trim("part").alias("part"))


QUERIES["str_49_split_rows"] = str_49_split_rows
ORACLES["str_49_split_rows"] = f"{ALL} select entity_id, trim(p) as part from (select entity_id, unnest(string_split(business_address, ',')) as p from r)"


def str_51_record_views(spark, d):
    x = X.record_views(A.s1(spark, d))
    return x.select("entity_id", "norm_addr", "country_key", "house_number", "postal_code", F.array_join("numbers", " ").alias("numbers"), "has_addr", "norm_name", "compact_name", "phonetic", "norm_full")


QUERIES["str_51_record_views"] = str_51_record_views

# Projections and predicates
QUERIES |= {
    "prj_01_rename": lambda s, d: A.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
    "prj_02_constant": lambda s, d: A.s1(s, d).select("entity_id", F.lit("S1").alias("source"), F.lit(1.0).alias("label")),
    "prj_03_coalesce": lambda s, d: A.truth(s, d).join(A.records(s, d, A.S2).select(F.col("entity_id").alias("target_id"), F.col("business_name").alias("a")), "target_id", "left").join(A.records(s, d, A.S3).select(F.col("entity_id").alias("target_id"), F.col("business_name").alias("b")), "target_id", "left").select("s1_id", "target_id", F.coalesce("a", "b").alias("name")),
    "prj_04_searched_case": lambda s, d: A.table(s, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 100000).alias("dear"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("done")),
    "prj_05_missing": lambda s, d: every(s, d).groupBy("country").agg(F.count_if(X.clean_missing(F.col("business_address")) == "").alias("missing")),
    "prj_06_not_empty": lambda s, d: every(s, d).where("business_address is not null and length(trim(business_address)) > 0").select("entity_id"),
    "prj_07_partition_filter": lambda s, d: every(s, d).where(F.col("country") == "France").select("entity_id", "country"),
    "prj_08_in_subquery": lambda s, d: A.table(s, d, "orders").join(A.table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey"),
    "prj_09_not_in_truth": lambda s, d: A.table(s, d, "customer").join(A.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey"),
    "prj_10_score_cutoff": lambda s, d: A.table(s, d, "lineitem").where("l_discount > 0.05").select("l_orderkey", "l_linenumber", "l_discount"),
    "prj_11_length_guard": lambda s, d: every(s, d).select("entity_id", X.token_normalize(F.col("business_address")).alias("k")).where("length(k) > 5").select("entity_id"),
    "prj_12_label": lambda s, d: A.table(s, d, "documents").select("doc_id").join(A.table(s, d, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("hit")), "doc_id", "left").select("doc_id", F.col("hit").isNotNull().cast("int").alias("label")),
    "prj_13_distinct": lambda s, d: every(s, d).select("country").distinct(),
    "prj_14_id_prefix": lambda s, d: A.targets(s, d).select("entity_id", F.substring("entity_id", 1, 2).alias("source"), F.col("entity_id").startswith("S3-").alias("is_s3")),
}
ORACLES |= {
    "prj_01_rename": "select c_custkey as id, c_name as name from customer",
    "prj_02_constant": f"with {A.RECORDS} select entity_id, 'S1' as source, 1.0::double as label from s1",
    "prj_03_coalesce": f"with {A.RECORDS} select s1_id, target_id, coalesce(a.business_name, b.business_name) as name from truth left join s2 a on a.entity_id = target_id left join s3 b on b.entity_id = target_id",
    "prj_04_searched_case": "select o_orderpriority, count(case when o_totalprice > 100000 then 1 end) as dear, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as done from orders group by 1",
    "prj_05_missing": f"{ALL} select country, count(case when {s_clean('business_address')} = '' then 1 end) as missing from r group by 1",
    "prj_06_not_empty": f"{ALL} select entity_id from r where business_address is not null and length(trim(business_address)) > 0",
    "prj_07_partition_filter": f"{ALL} select entity_id, country from r where country = 'France'",
    "prj_08_in_subquery": "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)",
    "prj_09_not_in_truth": "select c_custkey from customer left join orders on o_custkey = c_custkey where o_orderkey is null",
    "prj_10_score_cutoff": "select l_orderkey, l_linenumber, l_discount from lineitem where l_discount > 0.05",
    "prj_11_length_guard": f"{ALL} select entity_id from r where length({s_token('business_address')}) > 5",
    "prj_12_label": "select d.doc_id, (l.doc_id is not null)::int as label from documents d left join (select doc_id from labels where quality = 1) l on l.doc_id = d.doc_id",
    "prj_13_distinct": f"{ALL} select distinct country from r",
    "prj_14_id_prefix": f"with {A.RECORDS} select entity_id, substr(entity_id, 1, 2) as source, starts_with(entity_id, 'S3-') as is_s3 from targets",
}
