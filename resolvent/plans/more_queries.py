"""Registered queries of the remaining operators: keys, lookups, sampling, models, benchmarks of policies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys as Y
from ..functions import similarity as S
from ..functions import text as X
from ..functions.romanize import romanize
from ..operators import blocking as B
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import features as P
from ..operators import model as M
from ..operators import ranking as R
from ..sources import io
from . import adapters as A
from .match_queries import JAC, LEV, NUMERIC, PQ, TOK, labelled, pairs_of, training
from .relational_queries import CTX, K, PAIR, P3, REC, C, W, as_score, ids, key_rows, left, pred, right, scored, true, weighed
from .text_queries import every, s_tokens

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T = A.table
NAME, ADDR = lambda: F.col("business_name"), lambda: F.col("business_address")


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def show(name: str, build) -> None:
    """A function of records as a query; the text functions' registry takes it."""
    add(name, lambda s, d: every(s, d).select("entity_id", build().alias("value")))


# Keys and cleaners ------------------------------------------------------------
show("str_08_transliterate", lambda: romanize(NAME()))
add("str_09_romanized_digits", lambda s, d: T(s, d, "part").select("p_partkey", romanize(F.translate(F.col("p_partkey").cast("string"), "0123456789", "०१२३४५६७८९")).alias("value")), "select p_partkey, p_partkey::varchar as value from part")
show("str_13_legal_after_romanizing", lambda: X.legal_canonical(romanize(NAME())))
show("str_18_address_parser", lambda: F.to_json(Y.parsed_address(ADDR())))
show("str_20_base_clean", lambda: Y.base_clean(NAME()))
show("str_32_skeleton", lambda: F.array_join(F.transform(X.tokens(X.token_normalize(NAME())), Y.skeleton), " "))
show("str_33_sound_set", lambda: F.array_join(Y.sound_set(NAME()), " "))
show("str_34_phonetic_clean", lambda: Y.phonetic_clean(NAME()))
show("str_36_state", lambda: F.array_join(F.filter(F.transform(F.split(F.coalesce(ADDR(), F.lit("")), ","), Y.state_code), lambda x: x.isNotNull()), ","))
show("str_38_stem_key", lambda: F.array_join(F.transform(X.tokens(X.token_normalize(NAME())), Y.stem_key), " "))

# Blocking channels --------------------------------------------------------------
add("join_15_exact_name_capped", lambda s, d: B.capped(B.exact_block(left(s, d), right(s, d), ["country", "name"]), ["s1_id"], "target_id", 20), f"select s1_id, target_id from (select *, row_number() over (partition by s1_id order by target_id) as rn from ({PAIR} l.name = t.name where l.name <> '')) where rn <= 20")


def prefix8(df):
    joined = F.replace("name", F.lit(" "), F.lit(""))
    return df.where(F.length(joined) >= 6).withColumn("key", F.substring(joined, 1, 8))


add("join_16_compact_prefix", lambda s, d: B.first_in_block(prefix8(left(s, d)), prefix8(right(s, d)), ["country", "key"], 25), f"select s1_id, target_id from (select *, row_number() over (partition by s1_id order by target_id) as rn from ({PAIR} substr(replace(l.name, ' ', ''), 1, 8) = substr(replace(t.name, ' ', ''), 1, 8) where length(replace(l.name, ' ', '')) >= 6 and length(replace(t.name, ' ', '')) >= 6)) where rn <= 25")
add("join_20_postal_channel", lambda s, d: B.capped(B.exact_block(left(s, d), B.capped(right(s, d).where("postal <> ''"), ["country", "postal"], "target_id", 500), ["country", "postal"]), ["s1_id"], "target_id", 15), f"{K}, c as (select * from (select *, row_number() over (partition by country, postal order by target_id) as rn from t where postal <> '') where rn <= 500) select s1_id, target_id from (select s1_id, target_id, row_number() over (partition by s1_id order by target_id) as rn2 from l join c on l.country = c.country and l.postal = c.postal) where rn2 <= 15")
add("join_23_key_weights", lambda s, d: key_rows(right(s, d), "target_id").groupBy("family", "key").agg(F.count("*").alias("postings")).where("postings <= 60").groupBy("family", "postings").agg(F.count("*").alias("keys")))
add("join_25_normalised_score", lambda s, d: weighed(s, d).where("score > 0.5").select("s1_id", "target_id", F.round("score", 6).alias("score")))
add("join_29_positions", lambda s, d: T(s, d, "lineitem").join(T(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey").groupBy("p_size").agg(F.count("*").alias("n")), "select p_size, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1")

# Windows, cuts, sets ------------------------------------------------------------
add("win_05_max_ratio", lambda s, d: R.group_context(as_score(s, d)).select("s1_id", "target_id", F.round("ratio", 9).alias("ratio")), f"{C} select s1_id, target_id, round(prob / (max(prob) over (partition by s1_id) + 1e-6), 9) as ratio from c")
add("win_09_margins", lambda s, d: R.group_context(as_score(s, d)).select("s1_id", "target_id", "rank", F.round("gap", 9).alias("margin_to_top"), F.round("margin_next", 9).alias("margin_to_next"), (F.col("size") / 10.0).alias("density")), f"{CTX} select s1_id, target_id, rank, round(top - prob, 9) as margin_to_top, round(coalesce(prob - nxt, 0), 9) as margin_to_next, size / 10.0::double as density from y")
add("top_02_ordered_limit", lambda s, d: T(s, d, "supplier").orderBy("s_suppkey").limit(25).select("s_suppkey", "s_name"), "select s_suppkey, s_name from supplier order by s_suppkey limit 25")
add("top_04_top_k_per_row", lambda s, d: R.ranked(as_score(s, d)).where("rank <= 3").select("s1_id", "target_id", "score"), f"{C} select s1_id, target_id, prob as score from (select *, {W} as r from c) where r <= 3")
add("top_09_budget_of_three", lambda s, d: R.budget_cut(as_score(s, d), ((0.8, 0.2, 1), (0.6, 0.0, 2)), 4).select("s1_id", "target_id"), f"{CTX} select s1_id, target_id from y where rank <= case when top >= 0.8 and top - second >= 0.2 then 1 when top >= 0.6 and top - second >= 0 then 2 else 4 end")
add("top_12_report_order", lambda s, d: T(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).orderBy(F.desc("n"), "event_type"), "select event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1")
add("set_03_channel_union", lambda s, d: B.exact_block(left(s, d), right(s, d), ["country", "name"]).union(B.exact_block(left(s, d), right(s, d), ["country", "postal"], shortest=5)).dropDuplicates(["s1_id", "target_id"]), f"{K} select distinct s1_id, target_id from (select s1_id, target_id from l join t on l.country = t.country and l.name = t.name where l.name <> '' union all select s1_id, target_id from l join t on l.country = t.country and l.postal = t.postal where length(l.postal) >= 5)")
add("agg_19_micro_totals", lambda s, d: E.macro_f05(ids(s, d), pred(s, d), true(s, d)).select("precision", "recall"), f"{REC} select round(sum(tp) / sum(n_pred), 9)::double as precision, round(sum(tp) / sum(n_true), 9)::double as recall from w")

# Sampling: the samples are the feature ------------------------------------------
H = lambda c, salt="7-": F.md5(F.concat(F.lit(salt), F.col(c).cast("string")))
add("smp_02_choice", lambda s, d: T(s, d, "part").orderBy(H("p_partkey", "c-"), "p_partkey").limit(50).select("p_partkey"), "select p_partkey from part order by md5('c-' || p_partkey), p_partkey limit 50")


def shuffled(s, d):
    """Places in the order of a hash: inside 4,096 ranges of it, behind the rows of the ranges before (a table of that many rows)."""
    x = T(s, d, "supplier").select("s_suppkey", H("s_suppkey").alias("h")).withColumn("range", F.substring("h", 1, 3))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = x.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("h", "s_suppkey"))
    return x.join(F.broadcast(ahead), "range").select("s_suppkey", (F.col("ahead") + inside).alias("place"))


add("smp_03_shuffle", shuffled, "select s_suppkey, row_number() over (order by md5('7-' || s_suppkey), s_suppkey) as place from supplier")
add("smp_05_group_split", lambda s, d: scored(s, d).select("s1_id", "target_id", F.when(F.conv(F.substring(H("s1_id"), 1, 8), 16, 10).cast("bigint") % 10 < 3, "test").otherwise("train").alias("part")), f"{C} select s1_id, target_id, case when ('0x' || substr(md5('7-' || s1_id), 1, 8))::bigint % 10 < 3 then 'test' else 'train' end as part from c")
add("smp_07_held_out", lambda s, d: T(s, d, "orders").select("o_orderkey", (F.conv(F.substring(H("o_orderkey", "h-"), 1, 8), 16, 10).cast("bigint") % 100 < 15).alias("held_out")), "select o_orderkey, ('0x' || substr(md5('h-' || o_orderkey), 1, 8))::bigint % 100 < 15 as held_out from orders")


def smp_08(s, d):
    """Two random targets per reference record, by a hash of (record, draw) into the numbered targets."""
    n = T(s, d, "part").count()
    draws = T(s, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("draw"))
    draws = draws.withColumn("p_partkey", F.conv(F.substring(F.md5(F.concat_ws("-", "c_custkey", "draw")), 1, 8), 16, 10).cast("bigint") % F.lit(n) + 1)
    return draws.join(T(s, d, "part").select("p_partkey"), "p_partkey", "left_semi").select("c_custkey", "draw", "p_partkey")


add("smp_08_random_negatives", smp_08, "select * from (select c_custkey, draw::int as draw, ('0x' || substr(md5(c_custkey || '-' || draw), 1, 8))::bigint % (select count(*) from part) + 1 as p_partkey from customer, (select unnest([1, 2]) as draw)) where p_partkey in (select p_partkey from part)")
add("smp_09_hard_negatives", lambda s, d: R.ranked(scored(s, d).where("label = 0"), score="prob").where("rank <= 1").select(*P3), f"{C} select s1_id, target_id, prob from (select *, {W} as r from c where label = 0) where r <= 1")
add("smp_11_truth_and_distractors", lambda s, d: T(s, d, "part").join(T(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey").union(T(s, d, "part").orderBy(H("p_partkey"), "p_partkey").limit(200).select("p_partkey")).distinct(), "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 49) union (select p_partkey from part order by md5('7-' || p_partkey), p_partkey limit 200)")

# Features -----------------------------------------------------------------------
DIG = lambda c: F.filter(X.tokens(F.col(c)), lambda t: t.rlike("^[0-9]+$"))
SDIG = lambda c: f"list_filter({s_tokens(c)}, lambda v: regexp_full_match(v, '[0-9]+'))"
add("feat_11_score_pass_through", lambda s, d: as_score(s, d), f"{C} select s1_id, target_id, prob as score from c")
add("feat_21_strength_conflicts", lambda s, d: S.with_metrics(S.with_metrics(pairs_of(s, d), "name_a", "name_b", ["jaro_winkler"], "n_"), "addr_a", "addr_b", ["jaro_winkler"], "a_").select("s1_id", "target_id", ((F.col("n_jaro_winkler") >= 0.88) & (F.col("a_jaro_winkler") < 0.35)).cast("int").alias("name_strong_addr_weak"), ((F.col("n_jaro_winkler") < 0.60) & (F.col("a_jaro_winkler") >= 0.85)).cast("int").alias("name_weak_addr_strong")))
add("feat_23_competition", lambda s, d: R.group_context(as_score(s, d)).select("s1_id", "target_id", F.col("rank").alias("cand_rank"), F.round("gap", 9).alias("margin_to_top")), f"{CTX} select s1_id, target_id, rank as cand_rank, round(top - prob, 9) as margin_to_top from y")
add("feat_28_joined_variants", lambda s, d: S.with_metrics(pairs_of(s, d).withColumns({"ja": F.replace("name_a", F.lit(" "), F.lit("")), "jb": F.replace("name_b", F.lit(" "), F.lit(""))}), "ja", "jb", ["ratio", "partial"]).select("s1_id", "target_id", F.round("ratio", 9).alias("ratio"), F.round("partial", 9).alias("partial")))
add("feat_29_flags", lambda s, d: P.with_features(pairs_of(s, d), ["country_eq", "both_addr_present", "name_token_diff"]).select("s1_id", "target_id", "country_eq", "both_addr_present", "name_token_diff"), f"{PQ} select s1_id, target_id, 1.0::double as country_eq, (aa <> '' and ab <> '')::int::double as both_addr_present, abs(len(tna)::bigint - len(tnb)::bigint)::double as name_token_diff from p")
add("feat_31_counts", lambda s, d: TOK(pairs_of(s, d)).select("s1_id", "target_id", F.size("ta").cast("bigint").alias("n_a"), F.size("tb").cast("bigint").alias("n_b"), F.coalesce(F.try_element_at("ta", F.lit(1)) == F.try_element_at("tb", F.lit(1)), F.lit(False)).alias("first_equal")), f"{PQ} select s1_id, target_id, len(tna) as n_a, len(tnb) as n_b, coalesce(tna[1] = tnb[1], false) as first_equal from p")


def feat_30(s, d):
    """IDF-weighted Jaccard of names."""
    x = TOK(pairs_of(s, d))
    words = every(s, d).select("entity_id", F.explode(F.array_distinct(X.tokens(X.token_normalize(NAME())))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = every(s, d).agg(F.count("*").alias("n"))
    idf = words.join(F.broadcast(n)).select("token", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
    either = x.select("s1_id", "target_id", "ta", "tb", F.explode(F.array_union("ta", "tb")).alias("token")).join(idf, "token")
    both = F.array_contains(F.col("ta"), F.col("token")) & F.array_contains(F.col("tb"), F.col("token"))
    return either.groupBy("s1_id", "target_id").agg(F.round(F.sum(F.when(both, F.col("idf")).otherwise(0.0)) / F.sum("idf"), 6).alias("weighted_jaccard"))


add("feat_30_weighted_jaccard", feat_30)
add("feat_33_number_relation", lambda s, d: pairs_of(s, d).select("s1_id", "target_id", Y.number_relation(F.array_distinct(DIG("addr_a")), F.array_distinct(DIG("addr_b"))).alias("relation")))
add("feat_34_number_difference", lambda s, d: pairs_of(s, d).where("house_a rlike '^[0-9]+$' and house_b rlike '^[0-9]+$'").select("s1_id", "target_id", F.round(F.log10(F.abs(F.col("house_a").cast("bigint") - F.col("house_b").cast("bigint")) + 1), 9).alias("log_diff"), (F.length("house_a") - F.length("house_b")).alias("digits")), f"{PQ} select s1_id, target_id, round(log10(abs(ha::bigint - hb::bigint) + 1), 9) as log_diff, (length(ha) - length(hb))::int as digits from p where regexp_full_match(ha, '[0-9]+') and regexp_full_match(hb, '[0-9]+')")
add("feat_35_closest_delta", lambda s, d: pairs_of(s, d).select("s1_id", "target_id", Y.closest_delta(DIG("addr_a"), DIG("addr_b")).alias("delta")))
add("feat_38_sound_jaccard", lambda s, d: pairs_of(s, d).select("s1_id", "target_id", F.round(S.jaccard(Y.sound_set(F.col("name_a")), Y.sound_set(F.col("name_b"))), 9).alias("sound_jaccard")))
add("feat_39_format_noise", lambda s, d: every(s, d).select("entity_id", X.format_flags(NAME(), ADDR()).alias("f")).select("entity_id", *[F.shiftright("f", i).bitwiseAND(F.lit(1)).alias(f"bit{i}") for i in (0, 2, 12)], F.bit_count("f").alias("noise")))
add("feat_41_candidate_counts", lambda s, d: scored(s, d).select("s1_id", "target_id", F.count("*").over(Window.partitionBy("s1_id")).alias("per_record"), F.count("*").over(Window.partitionBy("target_id")).alias("per_target")), f"{C} select s1_id, target_id, count(*) over (partition by s1_id) as per_record, count(*) over (partition by target_id) as per_target from c")
add("feat_42_prerank", lambda s, d: R.group_context(as_score(s, d)).select("s1_id", "target_id", "rank", F.round(F.col("rank") / F.col("size"), 9).alias("rank_share"), F.round("ratio", 9).alias("ratio")), f"{CTX} select s1_id, target_id, rank, round(rank / size, 9) as rank_share, round(prob / (top + 1e-6), 9) as ratio from y")
add("lrn_04_delta_log_odds", lambda s, d: labelled(s, d).select("country_a", "label", Y.closest_delta(DIG("addr_a"), DIG("addr_b")).alias("delta")).where("delta is not null").groupBy("country_a", "delta").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).withColumn("pooled", F.sum("pos").over(Window.partitionBy("delta")) / F.sum("n").over(Window.partitionBy("delta"))).select("country_a", "delta", "n", F.round(F.when(F.col("n") >= 20, F.col("pos") / F.col("n")).otherwise(F.col("pooled")), 6).alias("rate")))



def edits(s, d):
    """Words that a pair's names do not share, with the single edit between them."""
    x = TOK(labelled(s, d)).select("s1_id", "target_id", "label", F.explode(F.array_except("ta", "tb")).alias("a"), "ta", "tb")
    x = x.select("s1_id", "target_id", "label", "a", F.explode(F.array_except("tb", "ta")).alias("b"))
    return S.with_edit_class(x, "a", "b")


add("feat_37_edit_classes", lambda s, d: edits(s, d).where("edit <> ''").select("s1_id", "target_id", "a", "b", "edit"))
add("lrn_03_edit_log_odds", lambda s, d: edits(s, d).groupBy("edit").agg(F.sum("label").alias("pos"), (F.count("*") - F.sum("label")).alias("neg")).select("edit", "pos", "neg", F.round(F.log((F.col("pos") + 1.0) / (F.col("neg") + 1.0)), 9).alias("log_odds")))

# Decisions and evaluation ---------------------------------------------------------
add("dec_05_rescue", lambda s, d: D.threshold_or_best(scored(s, d).where("target_id like 'S3-%'"), 0.75, 0.70).select(*P3), f"{C} select s1_id, target_id, prob from (select *, {W} as r from c where target_id like 'S3-%') where prob >= 0.75 or (r = 1 and prob >= 0.70)")
add("dec_06_source_caps", lambda s, d: R.capped_by_source(scored(s, d), 2, None).select(*P3), f"{C} select s1_id, target_id, prob from (select *, row_number() over (partition by s1_id, substr(target_id, 1, 2) order by prob desc, target_id) as a from c) where a <= 2")
add("dec_12_dynamic_expected_f", lambda s, d: D.dynamic_expected_f(scored(s, d)).select(*P3), f"{C}, e as (select *, {W} as k, sum(prob) over (partition by s1_id order by prob desc, target_id rows unbounded preceding) as sp from c), f as (select *, round(1.25 * sp / (k + 0.25 * greatest(sp, 1e-4)), 12) as f from e where k <= 8), b as (select s1_id, arg_max(k, (f, -k)) as bk from f group by 1), g as (select f.*, row_number() over (partition by f.s1_id, substr(target_id, 1, 2) order by prob desc, target_id) as a from f join b using (s1_id) where k <= bk) select s1_id, target_id, prob from g where a <= 5")
add("dec_14_plaza_filter", lambda s, d: D.plaza_filter(S.with_metrics(pairs_of(s, d), "name_a", "name_b", ["jaro_winkler"]).withColumnRenamed("jaro_winkler", "name_sim")).select("s1_id", "target_id"), f"{PQ} select s1_id, target_id from p where not (regexp_full_match(na, '[\\x00-\\x7F]{{3,}}') and regexp_full_match(nb, '[\\x00-\\x7F]{{3,}}') and len(list_intersect(tna, tnb)) = 0 and jaro_winkler_similarity(na, nb) < 0.45)")


def address_rule(s, d):
    """The rule on the pairs' own features; the likeness of the names stands for the model's probability."""
    x = P.with_features(pairs_of(s, d), ["name_levenshtein", "name_jaccard", "addr_missing"])
    x = S.with_metrics(x, "name_a", "name_b", ["jaro_winkler"]).withColumnRenamed("jaro_winkler", "name_sim")
    x = x.withColumns({"prob": F.round("name_levenshtein", 9), "score": F.round("name_jaccard", 9), "addr_missing": F.col("addr_missing") == 1})
    return D.missing_address_rule(x).select("s1_id", "target_id", "prob")


add("dec_16_missing_address", address_rule, f"{PQ}, f as (select s1_id, target_id, na, nb, not (aa <> '' and ab <> '') as missing, round({LEV('na', 'nb')}, 9) as prob, round({JAC('tna', 'tnb')}, 9) as score from p) select s1_id, target_id, prob from f where prob >= 0.70 or (missing and prob >= 0.50 and jaro_winkler_similarity(na, nb) >= 0.88 and score >= 0.60)")
add("eval_09_quantile_thresholds", lambda s, d: (lambda x: E.threshold_sweep(x, x.select(F.expr("percentile(prob, array(0.25, 0.5, 0.75))").alias("q")).first()["q"]).select(F.round("threshold", 9).alias("threshold"), "n", "tp"))(scored(s, d)), f"{C}, t as (select unnest(quantile_cont(prob, [0.25, 0.5, 0.75])) as t from c) select round(t, 9) as threshold, count(*) as n, sum(label)::bigint as tp from t join c on prob >= t group by 1")
add("eval_10_grid", lambda s, d: E.policy_grid(D.one_to_one(scored(s, d)), [0.4, 0.6, 0.8], [0.0, 0.2]))
add("eval_13_false_negatives", lambda s, d: R.group_context(scored(s, d), score="prob").where("label = 1 and prob < 0.6").select(F.when(F.col("rank") == 1, "best but weak").when(F.col("gap") < 0.1, "close to the best").when(F.col("size") > 4, "crowded").otherwise("outranked").alias("cause")).groupBy("cause").agg(F.count("*").alias("n")), f"{CTX} select case when rank = 1 then 'best but weak' when top - prob < 0.1 then 'close to the best' when size > 4 then 'crowded' else 'outranked' end as cause, count(*) as n from y where label = 1 and prob < 0.6 group by 1")
add("eval_19_recovered", lambda s, d: (lambda a, b, t: b.join(t, ["s1_id", "target_id"], "left_semi").join(a, ["s1_id", "target_id"], "left_anti").agg(F.count("*").alias("recovered")))(scored(s, d).where("prob >= 0.8"), scored(s, d).where("prob >= 0.5"), true(s, d).select("s1_id", "target_id")), f"{C} select count(*) as recovered from c where label = 1 and prob >= 0.5 and prob < 0.8")


def eval_21(s, d):
    """Adaptive cuts side by side: candidates kept and truth found."""
    base = as_score(s, d)
    truth = true(s, d).select("s1_id", "target_id").withColumn("hit", F.lit(1))
    out = None
    for name, cut in (("fixed 3", R.ranked(base).where("rank <= 3")), ("ratio", R.ratio_cut(base, 0.5, 1, 4)), ("steep", R.adaptive_cut(base, 5))):
        x = cut.select("s1_id", "target_id").join(truth, ["s1_id", "target_id"], "left").agg(F.count("*").alias("kept"), F.count("hit").alias("hits")).select(F.lit(name).alias("policy"), "kept", "hits")
        out = x if out is None else out.union(x)
    return out


add("eval_21_policies", eval_21, f"{CTX} select 'fixed 3' as policy, count(*) as kept, count(case when label = 1 then 1 end) as hits from y where rank <= 3 union all select 'ratio', count(*), count(case when label = 1 then 1 end) from y where rank <= 1 or (rank <= 4 and prob >= 0.5 * top) union all select 'steep', count(*), count(case when label = 1 then 1 end) from y where size <= 3 or rank <= case when top >= 0.85 and top - second > 0.35 then 3 else 5 end")

# Models, sources --------------------------------------------------------------------
add("ml_03_forest", lambda s, d: (lambda x: M.predict(M.fit(x, NUMERIC, M.forest(10, 4)), x).select("s1_id", "target_id", "label", "prob"))(training(s, d)))
add("ml_10_importances", lambda s, d: (lambda x: s.createDataFrame(M.importances(M.fit(x, NUMERIC, M.forest(10, 4)), NUMERIC), "feature string, importance double"))(training(s, d)))


def ml_12(s, d):
    """Training pairs: true pairs of the postal block and hard negatives that share a first name word."""
    first = F.slice(X.tokens(F.col("name")), 1, 1)
    hard = B.token_block(left(s, d), right(s, d), first, first, ["country"], 50, 3).join(A.truth(s, d), ["s1_id", "target_id"], "left_anti").withColumn("label", F.lit(0))
    return hard.unionByName(A.truth(s, d).withColumn("label", F.lit(1)))


add("ml_12_training_pairs", ml_12)


def preranked(s, d):
    """IR-17: candidates of a wide block that a cheap model ranks among the first or thinks likely."""
    x = training(s, d)
    model = M.fit(x, NUMERIC[:4], M.logistic())
    return B.pruned(x, lambda c: M.predict(model, c), 2, 0.5).select("s1_id", "target_id", "prob", "rank")


add("ir_17_preranked", preranked)
add("ml_06_ensemble", lambda s, d: M.ensemble_out_of_fold(training(s, d), NUMERIC, 2, learners=(M.gbt(3, 2), M.gbt(3, 3, seed=7), M.forest(5, 3))).select("s1_id", "target_id", "label", "prob"))


def saved_model(s, d):
    """A fitted pipeline written, read and used again (SNK-05)."""
    path = io.work_path(s, "matcher")
    x = training(s, d)
    M.fit(x, NUMERIC, M.logistic()).write().save(path)
    return M.predict(M.PipelineModel.load(path), x).select("s1_id", "target_id", F.round("prob", 9).alias("prob"))


add("snk_05_saved_model", saved_model)
add("src_03_trimmed_headers", lambda s, d: io.scan_source(s, _tsv(s, d)).select("entity_id", "country"), f"with {A.RECORDS} select entity_id, country from s1")
add("src_12_materialised", lambda s, d: _written(s, A.s1(s, d)).groupBy("country").agg(F.count("*").alias("n")), f"with {A.RECORDS} select country, count(*) as n from s1 group by 1")


def _tsv(s, d):
    path = io.work_path(s, "s1.tsv")
    io.write_tsv(A.s1(s, d), path)
    return path


def _written(s, df):
    path = io.work_path(s, "table")
    df.write.parquet(path)
    return s.read.schema(df.schema).parquet(path)
