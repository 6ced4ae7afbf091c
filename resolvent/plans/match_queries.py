"""Registered queries: retrieval (IR), pair features (FEAT), learned statistics (LRN), models (ML) and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as Y
from ..functions import similarity as S
from ..functions import text as X
from ..operators import blocking as B
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import features as P
from ..operators import model as M
from ..operators import ranking as R
from ..operators import tfidf as I
from ..sources import io
from . import adapters as A
from .relational_queries import K, PAIR, key_rows, keyed, left, right
from .text_queries import s_sorted, s_token, s_tokens

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T = A.table


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


# Passages of the benchmark as reference records, documents as targets --------
def passages(s, d):
    return T(s, d, "benchmark").select(F.col("item_id").alias("s1_id"), X.token_normalize(F.col("text")).alias("t"))


def documents(s, d):
    return T(s, d, "documents").select(F.col("doc_id").alias("target_id"), X.token_normalize(F.col("text")).alias("t"), F.coalesce("lang", F.lit("")).alias("lang"))


WORDS = lambda: F.filter(F.split("t", " "), lambda t: t != "")


def tfidf_sql(k, min_df=1, max_df=1.0, least=0.0, most=10**12):
    """Retrieval of passages over documents in SQL."""
    w = lambda rel, i: f"(select {i}, term, tf, idf from {rel} join idf using (term))"
    unit = lambda rel, i: f"(select {i}, term, (1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) ** 2) over (partition by {i})) as w from {w(rel, i)})"
    return f"""with q as (select item_id as s1_id, term, count(*) as tf from (select item_id, unnest({s_tokens(s_token('text'))}) as term from benchmark) group by 1, 2),
      t as (select doc_id as target_id, term, count(*) as tf from (select doc_id, unnest({s_tokens(s_token('text'))}) as term from documents) group by 1, 2),
      n as (select count(*) as n from documents),
      idf as (select term, ln((1 + n)::double / (1 + df)) + 1 as idf from (select term, count(*) as df, sum(tf) as total from t group by 1), n where df >= {min_df} and df <= {max_df} * n order by total desc, term limit {most}),
      p as (select s1_id, target_id, round(sum(a.w * b.w), 9) as score from {unit('q', 's1_id')} a join {unit('t', 'target_id')} b using (term) group by 1, 2 having round(sum(a.w * b.w), 9) > {least}),
      r as (select *, row_number() over (partition by s1_id order by score desc, target_id) as rank from p)
      select s1_id, target_id, round(score, 6) as score, rank from r where rank <= {k}"""


def retrieved(s, d, k=30, **kw):
    return I.retrieve(passages(s, d), documents(s, d), WORDS(), WORDS(), k=k, **kw)


_out = lambda df: df.select("s1_id", "target_id", F.round("score", 6).alias("score"), "rank")
add("ir_01_word_tfidf_topk", lambda s, d: _out(retrieved(s, d, 10, min_df=2, max_features=120_000)), tfidf_sql(10, 2, most=120_000))
add("ir_02_word_tfidf_max_df", lambda s, d: _out(retrieved(s, d, 10, min_df=3, max_df=0.25, max_features=80_000)), tfidf_sql(10, 3, 0.25, most=80_000))
add("ir_07_least_similarity", lambda s, d: _out(retrieved(s, d, 10, least=0.2)), tfidf_sql(10, least=0.2))


def names_of(s, d, spec, id_name):
    return A.records(s, d, spec).select(F.col("entity_id").alias(id_name), F.upper("country").alias("country"), X.token_normalize(F.col("business_name")).alias("n"), X.token_normalize(F.col("business_address")).alias("a"))


GRAMS = lambda c, lo=3, hi=4: X.padded_grams(F.col(c), lo, hi)
add("ir_03_char_tfidf_address", lambda s, d: _out(I.retrieve(names_of(s, d, A.S1, "s1_id"), names_of(s, d, A.S2, "target_id"), GRAMS("a"), GRAMS("a"), ["country"], short=True, k=5, max_df=0.25)))
add("ir_05_pruned_vectors", lambda s, d: _out(I.retrieve(names_of(s, d, A.S1, "s1_id"), names_of(s, d, A.S2, "target_id"), GRAMS("a"), GRAMS("a"), ["country"], short=True, k=5, max_df=0.1, top=16)))
add("ir_08_weak_queries", lambda s, d: I.weak_queries(passages(s, d), retrieved(s, d, 10, min_df=2)), f"with f as ({tfidf_sql(10, 2)}) select item_id as s1_id from benchmark left join (select s1_id, max(score) as top, count(*) as hits from f group by 1) on s1_id = item_id where top is null or top < 0.35 or hits < 5")


def boosted(s, d):
    """Passages that words find badly, by character grams; texts are normalised once and words asked once."""

    def written(df, name):
        df.write.parquet(path := io.work_path(s, name))
        return s.read.schema(df.schema).parquet(path)

    p, t = passages(s, d), written(documents(s, d).select("target_id", "t"), "normalised")
    weak = written(I.weak_queries(p, I.retrieve(p, t, WORDS(), WORDS(), k=10, min_df=2, few=("t", None))), "weak")
    return I.retrieve(p.join(weak, "s1_id", "left_semi"), t, X.char_grams(F.col("t"), 5), X.char_grams(F.col("t"), 5), k=10, least=0.10, max_df=0.05, few=("t", 5))


add("ir_09_recall_booster", boosted)
add("ir_10_score_fusion", lambda s, d: B.fuse([(B.exact_block(left(s, d), right(s, d), ["country", "name"]), 1.0), (B.exact_block(left(s, d), right(s, d), ["country", "addr"], shortest=6), 0.95), (B.exact_block(left(s, d), right(s, d), ["country", "postal", "house"]), 0.5)]), f"{K}, p as (select 0 as c, s1_id, target_id, 1.0 as sc from l join t on l.country = t.country and l.name = t.name where l.name <> '' union all select 1, s1_id, target_id, 0.95 from l join t on l.country = t.country and l.addr = t.addr where length(l.addr) >= 6 union all select 2, s1_id, target_id, 0.5 from l join t on l.country = t.country and l.postal = t.postal and l.house = t.house where l.house <> '') select s1_id, target_id, max(sc)::double as score, count(distinct c) as votes from p group by 1, 2")
add("ir_11_votes_priority", lambda s, d: R.ranked(B.fuse([(B.exact_block(left(s, d), right(s, d), ["country", "name"]), 0.6), (B.exact_block(left(s, d), right(s, d), ["country", "postal", "house"]), 0.5)]).withColumn("priority", F.col("score") + 0.1 * F.least(F.lit(3), "votes")), score="priority").where("rank <= 5").select("s1_id", "target_id", "rank"), f"{K}, p as (select 0 as c, s1_id, target_id, 0.6 as sc from l join t on l.country = t.country and l.name = t.name where l.name <> '' union all select 1, s1_id, target_id, 0.5 from l join t on l.country = t.country and l.postal = t.postal and l.house = t.house where l.house <> ''), f as (select s1_id, target_id, max(sc) + 0.1 * least(3, count(distinct c)) as pr from p group by 1, 2) select s1_id, target_id, rank from (select *, row_number() over (partition by s1_id order by pr desc, target_id) as rank from f) where rank <= 5")


def lexical_score(names="n_jaro_winkler", addresses="a_jaro_winkler"):
    """Names .70 / .30, addresses .50 / .50, blended .60 / .40 where both addresses are there; bonuses up to 1 in all."""
    name = 0.70 * F.col(names) + 0.30 * S.levenshtein_ratio(F.col("name_a"), F.col("name_b"))
    address = 0.50 * F.col(addresses) + 0.50 * S.jaccard(X.tokens(F.col("addr_a")), X.tokens(F.col("addr_b")))
    x = F.when((F.col("addr_a") != "") & (F.col("addr_b") != ""), 0.60 * name + 0.40 * address).otherwise(name)
    one, plus = F.lit(1.0), lambda x, test, more: F.when(test, F.least(F.lit(1.0), x + more)).otherwise(x)
    x = plus(x, (F.col("name_a") == F.col("name_b")) & (F.col("name_a") != ""), 0.15)
    x = plus(x, (F.col("postal_a") == F.col("postal_b")) & (F.col("postal_a") != ""), 0.08)
    return F.least(one, plus(x, F.col("votes") >= 3, 0.05))


def reranked(s, d):
    l, r = left(s, d), right(s, d)
    found = B.fuse([(B.exact_block(l, r, ["country", "name"]), 1.0), (B.exact_block(l, r, ["country", "addr"], shortest=6), 0.95), (B.exact_block(l, r, ["country", "postal", "house"]), 0.5)])
    x = pairs_of(s, d).join(found.select("s1_id", "target_id", "votes"), ["s1_id", "target_id"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    x = S.with_metrics(S.with_metrics(x, "name_a", "name_b", ["jaro_winkler"], "n_"), "addr_a", "addr_b", ["jaro_winkler"], "a_")
    return R.ranked(x.withColumn("score", F.round(lexical_score(), 6))).where("rank <= 3").select("s1_id", "target_id", "rank", "score")


add("ir_04_joint_char_tfidf", lambda s, d: I.retrieve(names_of(s, d, A.S1, "s1_id"), names_of(s, d, A.S2, "target_id"), GRAMS("n", 3, 5), GRAMS("n", 3, 5), ["country"], short=True, k=5, max_df=0.5, max_features=300_000, joint=True).select("s1_id", "target_id", "rank"))
add("ir_12_lexical_rerank", reranked)
add("ir_13_rare_tokens", lambda s, d: I.retrieve(passages(s, d), documents(s, d), F.array_distinct(WORDS()), F.array_distinct(WORDS()), k=10, max_df=0.02, top=10).select("s1_id", "target_id", "rank"))
add("ir_14_phonetic_channel", lambda s, d: I.retrieve(*[names_of(s, d, sp, i).where("country = 'INDIA'").withColumn("n", Y.phonetic_clean(F.col("n"))) for sp, i in ((A.S1, "s1_id"), (A.S2, "target_id"))], GRAMS("n"), GRAMS("n"), ["country"], short=True, k=10, least=0.25))
add("ir_15_missing_address_channel", lambda s, d: I.retrieve(names_of(s, d, A.S1, "s1_id"), names_of(s, d, A.S2, "target_id").where("a = ''"), F.split("n", " "), F.split("n", " "), ["country"], short=True, k=5, least=0.40).select("s1_id", "target_id", "rank"))
add("ir_16_state_expanded_channel", lambda s, d: I.retrieve(*[names_of(s, d, sp, i).withColumn("f", X.states_expanded(F.concat_ws(" ", "n", "a"))) for sp, i in ((A.S1, "s1_id"), (A.S3, "target_id"))], F.split("f", " "), F.split("f", " "), ["country"], short=True, k=10, least=0.30).select("s1_id", "target_id", "rank"))
add("ir_18_oov_share", lambda s, d: names_of(s, d, A.S3, "target_id").select("target_id", "country", F.explode(X.tokens(F.col("n"))).alias("w")).join(names_of(s, d, A.S1, "s1_id").select("country", F.explode(X.tokens(F.col("n"))).alias("w")).distinct().withColumn("known", F.lit(1)), ["country", "w"], "left").groupBy("target_id").agg(F.round(F.avg(F.col("known").isNull().cast("int")), 9).alias("oov")), f"with {A.RECORDS}, v as (select distinct upper(country) as country, unnest({s_tokens(s_token('business_name'))}) as w from s1), q as (select entity_id as target_id, upper(country) as country, unnest({s_tokens(s_token('business_name'))}) as w from s3) select target_id, round(avg((v.w is null)::int), 9) as oov from q left join v on v.country = q.country and v.w = q.w group by 1")


# Candidate pairs with both records' views ------------------------------------
def pairs_of(s, d):
    l, r = left(s, d), right(s, d)
    cand = B.exact_block(l, r, ["country", "postal"], shortest=5)
    a = l.select("s1_id", *[F.col(c).alias(f"{c}_a") for c in ("name", "addr", "postal", "house", "country")])
    b = r.select("target_id", *[F.col(c).alias(f"{c}_b") for c in ("name", "addr", "postal", "house", "country")])
    return cand.join(a, "s1_id").join(b, "target_id")


def labelled(s, d):
    hit = A.truth(s, d).withColumn("hit", F.lit(1))
    return pairs_of(s, d).join(hit, ["s1_id", "target_id"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit")


PQ = f"{K}, p as (select s1_id, target_id, l.name as na, t.name as nb, l.addr as aa, t.addr as ab, l.postal as pa, t.postal as pb, l.house as ha, t.house as hb, {s_tokens('l.name')} as tna, {s_tokens('t.name')} as tnb, {s_tokens('l.addr')} as taa, {s_tokens('t.addr')} as tab from l join t on l.country = t.country and l.postal = t.postal where length(l.postal) >= 5)"
INTER = lambda a, b: f"len(list_intersect({a}, {b}))"
JAC = lambda a, b: f"case when len({a}) > 0 and len({b}) > 0 then {INTER(a, b)}::double / len(list_distinct(list_concat({a}, {b}))) else 0 end"
OVER = lambda a, b: f"case when len({a}) > 0 and len({b}) > 0 then {INTER(a, b)}::double / least(len(list_distinct({a})), len(list_distinct({b}))) else 0 end"
LEV = lambda a, b: f"case when length({a}) > 0 and length({b}) > 0 then 1 - levenshtein({a}, {b})::double / greatest(length({a}), length({b})) else 0 end"
GR = lambda x: f"(case when length({x}) = 0 then []::varchar[] else list_distinct(list_transform(range(1, greatest(length({x}) - 2, 1) + 1), lambda i: substr({x}, i, 3))) end)"
COS = lambda a, b: f"case when len({a}) > 0 and len({b}) > 0 then {INTER(a, b)}::double / sqrt((len({a}) * len({b}))::double) else 0 end"
DIG = lambda t: f"list_filter({t}, lambda v: regexp_matches(v, '[0-9]'))"
LAST3 = lambda t: f"case when len({t}) >= 3 then list_slice({t}, -3, -1) else {t} end"
BOTH = "(aa <> '' and ab <> '')"
FEATURES = {
    "feat_01_exact": {"name_exact": "(na = nb and na <> '')::int::double", "addr_exact": "(aa = ab and aa <> '')::int::double"},
    "feat_02_levenshtein": {"name_levenshtein": LEV("na", "nb"), "addr_levenshtein": LEV("aa", "ab")},
    "feat_04_jaccard": {"name_jaccard": JAC("tna", "tnb"), "addr_jaccard": JAC("taa", "tab")},
    "feat_05_overlap": {"name_token_overlap": OVER("tna", "tnb"), "addr_token_overlap": OVER("taa", "tab")},
    "feat_06_length_ratio": {"name_length_ratio": "case when na <> '' and nb <> '' then least(length(na), length(nb))::double / greatest(length(na), length(nb)) else 0 end"},
    "feat_07_presence": {"has_addr_s1": "(aa <> '')::int::double", "has_addr_tgt": "(ab <> '')::int::double", "both_addr_present": f"{BOTH}::int::double", "addr_missing": f"(not {BOTH})::int::double"},
    "feat_08_postal": {"postal_match": "(pa = pb and pa <> '')::int::double"},
    "feat_09_house": {"house_num_match": "(ha = hb and ha <> '')::int::double"},
    "feat_10_agree": {"name_addr_agree": "(na = nb and na <> '' and aa = ab and aa <> '')::int::double", "name_postal_agree": "(na = nb and na <> '' and pa = pb and pa <> '')::int::double"},
    "feat_12_interactions": {"name_x_addr_present": f"({JAC('tna', 'tnb')}) * {BOTH}::int", "name_x_addr_missing": f"({JAC('tna', 'tnb')}) * (not {BOTH})::int"},
    "feat_13_missing": {"either_addr_missing": f"(not {BOTH})::int::double", "name_strong_addr_missing": f"(({LEV('na', 'nb')}) >= 0.88 and not {BOTH})::int::double"},
    "feat_14_containment": {"name_containment": "(na <> '' and nb <> '' and (contains(na, nb) or contains(nb, na)))::int::double"},
    "feat_15_token_diff": {"name_token_diff": "abs(len(tna)::bigint - len(tnb)::bigint)::double"},
    "feat_16_char3_jaccard": {"name_char3_jaccard": JAC(GR("na"), GR("nb")), "addr_char3_jaccard": JAC(GR("aa"), GR("ab"))},
    "feat_17_char3_cosine": {"name_char3_cos": COS(GR("na"), GR("nb")), "addr_char3_cos": COS(GR("aa"), GR("ab"))},
    "feat_19_city": {"city_overlap": JAC(f"({LAST3('taa')})", f"({LAST3('tab')})")},
    "feat_20_numeric": {"numeric_overlap": JAC(DIG("taa"), DIG("tab"))},
    "feat_22_source": {"target_source_s3": "starts_with(target_id, 'S3-')::int::double"},
    "feat_24_first_token": {"first_token_match": "coalesce((tna[1] = tnb[1]), false)::int::double", "first_token_conflict": "coalesce((tna[1] <> tnb[1]), false)::int::double"},
    "feat_25_number_conflict": {"primary_num_mismatch": "(ha <> '' and hb <> '' and ha <> hb)::int::double", "name_high_but_num_conflict": f"(({LEV('na', 'nb')}) > 0.85 and ha <> '' and hb <> '' and ha <> hb)::int::double"},
    "feat_26_cross": {"cross_prod": f"({LEV('na', 'nb')}) * ({LEV('aa', 'ab')})"},
    "feat_32_number_near": {"number_near": f"(len(list_filter({DIG('taa')}, lambda a: len(list_filter({DIG('tab')}, lambda b: levenshtein(a, b) <= 1)) > 0)) > 0)::int::double"},
    "feat_36_token_changes": {"added_tokens": "len(list_distinct(list_filter(tnb, lambda v: not list_contains(tna, v))))::double", "dropped_tokens": "len(list_distinct(list_filter(tna, lambda v: not list_contains(tnb, v))))::double"},
}
for _name, _cols in FEATURES.items():
    add(
        _name,
        lambda s, d, c=tuple(_cols): P.with_features(pairs_of(s, d), list(c)).select("s1_id", "target_id", *[F.round(x, 9).alias(x) for x in c]),
        f"{PQ} select s1_id, target_id, " + ", ".join(f"round(({e})::double, 9) as {n}" for n, e in _cols.items()) + " from p",
    )


def distinct_names(s, d):
    n = T(s, d, "part").select("p_name").distinct()
    return n.withColumnRenamed("p_name", "a").join(n.withColumnRenamed("p_name", "b"), F.substring("a", 1, 1) == F.substring("b", 1, 1))


add("feat_03_jaro_winkler", lambda s, d: S.with_metrics(distinct_names(s, d), "a", "b", ["jaro_winkler"]).select("a", "b", F.round("jaro_winkler", 6).alias("jw")), "with n as (select distinct p_name from part) select x.p_name as a, y.p_name as b, round(jaro_winkler_similarity(x.p_name, y.p_name), 6) as jw from n x join n y on substr(x.p_name, 1, 1) = substr(y.p_name, 1, 1)")
add("feat_27_fuzzy_ratios", lambda s, d: S.with_metrics(distinct_names(s, d), "a", "b", ["ratio", "token_sort", "token_set", "partial"]))
add("feat_18_phonetic_similarity", lambda s, d: S.with_metrics(pairs_of(s, d).withColumns({"sa": X.phonetic_skeleton(F.col("name_a")), "sb": X.phonetic_skeleton(F.col("name_b"))}), "sa", "sb", ["jaro_winkler"]).select("s1_id", "target_id", F.round("jaro_winkler", 9).alias("name_phonetic_sim")))
add("feat_43_all_features", lambda s, d: P.with_features(pairs_of(s, d)).select("s1_id", "target_id", *P.pair_features()))

TOK = lambda df: df.withColumns({"ta": X.tokens(F.col("name_a")), "tb": X.tokens(F.col("name_b"))})
add("lrn_01_token_log_odds", lambda s, d: P.token_log_odds(TOK(labelled(s, d)), 5), f"{PQ}, q as (select p.*, (u.s1_id is not null)::int as label from p left join truth u on u.s1_id = p.s1_id and u.target_id = p.target_id), c as (select 1 as added, label, unnest(list_distinct(list_filter(tnb, lambda v: not list_contains(tna, v)))) as token from q union all select 0, label, unnest(list_distinct(list_filter(tna, lambda v: not list_contains(tnb, v)))) from q), g as (select token, added, sum(label)::bigint as pos, (count(*) - sum(label))::bigint as neg from c group by 1, 2), n as (select sum(label) as np, count(*) - sum(label) as nn from q) select token, added, pos, neg, round(ln((pos + 1.0) / (np + 1)) - ln((neg + 1.0) / (nn + 1)), 9)::double as log_odds from g, n where pos + neg >= 5")
add("lrn_02_back_off", lambda s, d: (lambda t: t.join(t.groupBy(F.substring("token", 1, 3).alias("class")).agg(F.avg("log_odds").alias("by_class")), F.substring("token", 1, 3) == F.col("class")).select("token", "added", F.round(F.when(F.col("pos") + F.col("neg") >= 20, F.col("log_odds")).otherwise(F.col("by_class")), 6).alias("log_odds")))(P.token_log_odds(TOK(labelled(s, d)), 5)))
add("lrn_06_feature_separation", lambda s, d: E.separation(P.with_features(labelled(s, d), ["name_jaccard"]).withColumn("name_jaccard", F.round("name_jaccard", 9)), "name_jaccard", "label"))

NUMERIC = ["name_levenshtein", "name_jaccard", "addr_levenshtein", "addr_jaccard", "house_num_match", "name_char3_cos", "addr_missing", "first_token_match"]


def training(s, d):
    """Labelled pairs with features, written: a learner reads them many times."""
    x, path = P.with_features(labelled(s, d), NUMERIC).select("s1_id", "target_id", "label", *NUMERIC), io.work_path(s, "training")
    x.write.parquet(path)
    return s.read.schema(x.schema).parquet(path)


add("ml_01_boosted_trees", lambda s, d: (lambda x: M.predict(M.fit(x, NUMERIC, M.gbt(8, 3)), x).select("s1_id", "target_id", "label", "prob"))(training(s, d)))
add("ml_05_logistic", lambda s, d: (lambda x: M.predict(M.fit(x, NUMERIC, M.logistic()), x).select("s1_id", "target_id", "label", "prob"))(training(s, d)))
add("ml_08_out_of_fold", lambda s, d: M.out_of_fold(training(s, d), NUMERIC, M.logistic()).select("s1_id", "target_id", "label", "prob"))


# The flagship: retrieve, decide, one row per reference record ------------------
def flagship(s, d):
    """For every passage the documents that hold it: TF-IDF retrieval, adaptive cut, threshold, list sink."""
    found = R.adaptive_cut(retrieved(s, d, 30, min_df=2), ceiling=30)
    scored = found.withColumn("prob", F.col("score"))
    kept = D.threshold_policy(scored, 0.35, 0.30)
    lists = kept.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("target_id")), ",").alias("matched_ids"), F.count("*").alias("n"))
    return passages(s, d).select("s1_id").join(lists, "s1_id", "left").select("s1_id", F.coalesce("matched_ids", F.lit("")).alias("matched_ids"), F.coalesce("n", F.lit(0)).alias("n"))


add("flagship_resolution", flagship)
