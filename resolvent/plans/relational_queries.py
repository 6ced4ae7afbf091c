"""Registered queries: joins and blocking, aggregation, windows, top-k, sets, sampling, decisions, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocking as B
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import ranking as R
from . import adapters as A
from .text_queries import s_token, s_tokens

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


# Keyed records --------------------------------------------------------------
def keyed(df, id_name):
    return df.select(
        F.col("entity_id").alias(id_name), F.upper("country").alias("country"), X.token_normalize(F.col("business_name")).alias("name"), X.token_normalize(F.col("business_address")).alias("addr"),
        X.postal_by_country(F.col("business_address"), F.col("country")).alias("postal"), X.house_leading(F.regexp_replace(F.coalesce("business_address", F.lit("")), "^# ", "")).alias("house"),
    )


def left(s, d):
    return keyed(A.s1(s, d), "s1_id")


def right(s, d):
    return keyed(A.targets(s, d), "target_id")


def _keyed_sql(rel, id_name):
    post = "case when upper(trim(country)) = 'INDIA' then regexp_extract(coalesce(business_address, ''), '\\b([0-9]{6})\\b', 1) else regexp_extract(coalesce(business_address, ''), '\\b([0-9]{5})\\b', 1) end"
    house = "regexp_extract(coalesce(business_address, ''), '^(# )?\\s*([0-9]+)', 2)"
    return f"(select entity_id as {id_name}, upper(country) as country, {s_token('business_name')} as name, {s_token('business_address')} as addr, {post} as postal, {house} as house from {rel})"


K = f"with {A.RECORDS}, l as {_keyed_sql('s1', 's1_id')}, t as {_keyed_sql('targets', 'target_id')}"
PAIR = f"{K} select s1_id, target_id from l join t on l.country = t.country and"

add("join_01_inner", lambda s, d: A.table(s, d, "orders").join(A.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name"), "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
add("join_02_union_then_join", lambda s, d: A.truth(s, d).join(A.targets(s, d).withColumnRenamed("entity_id", "target_id"), "target_id").select("s1_id", "target_id", "business_name"), f"with {A.RECORDS} select s1_id, target_id, coalesce(a.business_name, b.business_name) as business_name from truth left join s2 a on a.entity_id = target_id left join s3 b on b.entity_id = target_id")
add("join_03_exact_name", lambda s, d: B.exact_block(left(s, d), right(s, d), ["country", "name"], shortest=3), f"{PAIR} l.name = t.name where length(l.name) > 2")
add("join_04_exact_address", lambda s, d: B.exact_block(left(s, d), right(s, d), ["country", "addr"], shortest=6), f"{PAIR} l.addr = t.addr where length(l.addr) > 5")
add("join_05_name_and_address", lambda s, d: B.exact_block(left(s, d), right(s, d), ["country", "name", "addr"]), f"{PAIR} l.name = t.name and l.addr = t.addr where l.addr <> ''")
add("join_06_name_and_postal", lambda s, d: B.exact_block(left(s, d), right(s, d), ["country", "name", "postal"], shortest=5), f"{PAIR} l.name = t.name and l.postal = t.postal where length(l.postal) >= 5")
add("join_07_postal_and_house", lambda s, d: B.exact_block(left(s, d), right(s, d).withColumn("h", F.col("house")), ["country", "postal", "house"]), f"{PAIR} l.postal = t.postal and l.house = t.house where l.house <> ''")


def _prefixed(df):
    return df.withColumns({"p5": F.concat(F.lit("n"), F.substring("name", 1, 5), F.lit("|"), F.col("postal")), "p6": F.substring("addr", 1, 6)})


add("join_08_disjunctive_prefix", lambda s, d: B.disjunctive_block(_prefixed(left(s, d)), _prefixed(right(s, d)).where("addr <> ''"), ["country"], ["p5", "p6"]), f"{K} select distinct s1_id, target_id from l join t on l.country = t.country and ((substr(l.name, 1, 5) = substr(t.name, 1, 5) and l.postal = t.postal) or substr(l.addr, 1, 6) = substr(t.addr, 1, 6)) where t.addr <> ''")
add("join_09_prefix_inequality", lambda s, d: A.table(s, d, "supplier").alias("a").join(A.table(s, d, "supplier").alias("b"), (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") != F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b")), "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey")
add("join_10_anti", lambda s, d: A.table(s, d, "part").join(A.table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey"), "select p_partkey from part left join (select distinct l_partkey from lineitem) on l_partkey = p_partkey where l_partkey is null")
add("join_11_semi", lambda s, d: A.table(s, d, "documents").join(A.table(s, d, "labels"), "doc_id", "left_semi").select("doc_id", "source"), "select doc_id, source from documents where doc_id in (select doc_id from labels)")
add("join_12_anchor_capped", lambda s, d: B.capped(B.exact_block(left(s, d), right(s, d), ["country", "name"]), ["s1_id"], "target_id", 5), f"select s1_id, target_id from (select *, row_number() over (partition by s1_id order by target_id) as rn from ({PAIR} l.name = t.name where l.name <> '')) where rn <= 5")


def _compact8(df):
    return df.withColumn("key", F.substring(F.replace("name", F.lit(" "), F.lit("")), 1, 8))


add("join_13_joined_prefix", lambda s, d: B.first_in_block(_compact8(left(s, d)), _compact8(right(s, d)), ["country", "key"], 25, shortest=8), f"select s1_id, target_id from (select *, row_number() over (partition by s1_id order by target_id) as rn from ({PAIR} substr(replace(l.name, ' ', ''), 1, 8) = substr(replace(t.name, ' ', ''), 1, 8) where length(replace(l.name, ' ', '')) >= 8 and length(replace(t.name, ' ', '')) >= 8)) where rn <= 25")
add("join_14_postal_anchor", lambda s, d: B.capped(B.exact_block(left(s, d), B.capped(right(s, d), ["country", "postal"], "target_id", 250), ["country", "postal"], shortest=5), ["s1_id"], "target_id", 25), f"{K}, c as (select * from (select *, row_number() over (partition by country, postal order by target_id) as rn from t) where rn <= 250) select s1_id, target_id from (select s1_id, target_id, row_number() over (partition by s1_id order by target_id) as rn2 from l join c on l.country = c.country and l.postal = c.postal where length(l.postal) >= 5) where rn2 <= 25")


def _token_channel(name, column, cap, take, shortest, first_left, first_right):
    def build(s, d):
        lt, rt = (F.slice(X.tokens(F.col(column)), 1, n) for n in (first_left, first_right))
        return B.token_block(left(s, d), right(s, d), lt, rt, ["country"], cap, take, shortest=shortest)

    sql = f"""{K}, i as (select * from (select target_id, country, token, row_number() over (partition by country, token order by target_id) as rn
        from (select distinct target_id, country, unnest(list_slice({s_tokens(column)}, 1, {first_right})) as token from t) where length(token) >= {shortest}) where rn <= {cap}),
      q as (select distinct s1_id, country, unnest(list_slice({s_tokens(column)}, 1, {first_left})) as token from l)
      select distinct s1_id, target_id from (select s1_id, target_id, row_number() over (partition by s1_id, q.token order by target_id) as rn
        from q join i on q.country = i.country and q.token = i.token where length(q.token) >= {shortest}) where rn <= {take}"""
    add(name, build, sql)


_token_channel("join_17_name_tokens", "name", 500, 35, 1, 3, 4)
_token_channel("join_19_address_tokens", "addr", 500, 15, 4, 2, 3)


def join_18(s, d):
    sk = lambda df: df.withColumn("sk", X.phonetic_skeleton(F.col("name")))
    t = lambda: F.slice(X.tokens(F.col("sk")), 1, 2)
    return B.token_block(sk(left(s, d)), sk(right(s, d)), t(), t(), ["country"], 500, 20, shortest=3)


add("join_18_phonetic_tokens", join_18)


def join_21(s, d):
    def keys(df):
        first = F.try_element_at(X.tokens(F.col("name")), F.lit(1))
        return df.withColumns({"k1": F.array_join(X.core_tokens(F.col("name")), " "), "k2": F.concat_ws("|", "postal", first), "k3": F.concat_ws("|", "house", first)}).where("postal <> '' and house <> ''")

    return B.disjunctive_block(keys(left(s, d)), keys(right(s, d)), ["country"], ["k2", "k3"])


FIRST = lambda r: f"{s_tokens(r + '.name')}[1]"
add("join_21_composite_keys", join_21, f"{K} select distinct s1_id, target_id from l join t on l.country = t.country and (l.postal = t.postal or l.house = t.house) and {FIRST('l')} = {FIRST('t')} where l.postal <> '' and l.house <> '' and t.postal <> '' and t.house <> ''")


def key_rows(df, id_name):
    words = df.select(id_name, "country", X.tokens(F.col("name")).alias("n"), X.tokens(F.col("addr")).alias("a"))
    words = words.select("*", F.filter("a", lambda t: t.rlike("[0-9]")).alias("d"))
    return words.select(id_name, F.explode(B.multi_keys(*map(F.col, ("country", "n", "a", "d")))).alias("k")).select(id_name, "k.*")


def weighed(s, d):
    """Pairs by weighted keys; keys take much time for the bytes of a record, so records are dealt out first."""
    rows = lambda df, name: key_rows(keyed(B.in_parts(df, 20_000, "entity_id"), name), name)
    return B.weighted_key_join(rows(A.s1(s, d), "s1_id"), rows(A.targets(s, d), "target_id"), 60)


add("join_22_multi_keys", lambda s, d: key_rows(left(s, d), "s1_id").groupBy("family").agg(F.count("*").alias("keys"), F.count_distinct("s1_id").alias("records")))
add("join_24_weighted_key_join", lambda s, d: R.ranked(weighed(s, d).withColumn("score", F.round("score", 9)), name="rank").where("rank <= 10").select("s1_id", "target_id", "rank", "score", "n_keys"))
add("join_26_reserved_slots", lambda s, d: R.any_rank_cut(weighed(s, d).withColumns({c: F.round(c, 9) for c in ("score", "bs_name", "bs_address", "bs_cross")}), {"score": 15, "bs_name": 4, "bs_address": 4, "bs_cross": 4}).select("s1_id", "target_id"))
add("join_27_hard_negatives", lambda s, d: B.token_block(left(s, d), right(s, d), F.slice(X.tokens(F.col("name")), 1, 1), F.slice(X.tokens(F.col("name")), 1, 1), ["country"], 50, 5).join(A.truth(s, d), ["s1_id", "target_id"], "left_anti"), None)
add("join_28_wide_merge", lambda s, d: A.table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).join(A.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey"), "select o_custkey, n, c_acctbal from (select o_custkey, count(*) as n from orders group by 1) join customer on c_custkey = o_custkey")
add("join_30_within_partition", lambda s, d: A.table(s, d, "customer").join(A.table(s, d, "supplier"), F.col("c_nationkey") == F.col("s_nationkey")).groupBy("c_nationkey").agg(F.count("*").alias("pairs"), F.round(F.sum(F.col("c_acctbal") - F.col("s_acctbal")), 2).alias("diff")).select("c_nationkey", "pairs"), "select c_nationkey, count(*) as pairs from customer join supplier on c_nationkey = s_nationkey group by 1")

# Aggregation ----------------------------------------------------------------
T = A.table
add("agg_01_conditional_counts", lambda s, d: T(s, d, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 500).alias("short"), F.count_if(F.col("lang") == "en").alias("english")), "select count(*) as n, count(case when n_chars < 500 then 1 end) as short, count(case when lang = 'en' then 1 end) as english from documents")
add("agg_02_group_count", lambda s, d: T(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "select source, count(*) as n from documents group by 1")
add("agg_03_distinct_counts", lambda s, d: T(s, d, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("supps"), F.count_distinct("l_partkey", "l_suppkey").alias("pairs")), "select count(distinct l_partkey) as parts, count(distinct l_suppkey) as supps, count(distinct (l_partkey, l_suppkey)) as pairs from lineitem")
add("agg_04_frequency_quantiles", lambda s, d: T(s, d, "lineitem").groupBy("l_partkey").count().agg(F.round(F.avg("count"), 9).alias("mean"), F.expr("percentile(count, 0.5)").alias("median"), F.expr("percentile(count, 0.95)").alias("p95"), F.max("count").alias("most"), F.round(F.avg((F.col("count") == 1).cast("int")), 9).alias("single")), "select round(avg(c), 9) as mean, quantile_cont(c, 0.5)::double as median, quantile_cont(c, 0.95)::double as p95, max(c) as most, round(avg((c = 1)::int), 9) as single from (select count(*) as c from lineitem group by l_partkey)")
add("agg_05_top_tokens", lambda s, d: T(s, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "token").limit(20), "select token, count(*) as df from (select distinct p_partkey, unnest(string_split(p_name, ' ')) as token from part) group by 1 order by 2 desc, 1 limit 20")
add("agg_06_collisions", lambda s, d: T(s, d, "part").groupBy("p_name").count().agg(F.count("*").alias("names"), F.round(F.avg("count"), 9).alias("mean"), F.max("count").alias("most")), "select count(*) as names, round(avg(c), 9) as mean, max(c) as most from (select count(*) as c from part group by p_name)")
add("agg_07_group_sizes", lambda s, d: T(s, d, "events").groupBy("user_id").count().agg(F.expr("percentile(count, 0.95)").alias("p95"), F.expr("percentile(count, 0.99)").alias("p99")), "select quantile_cont(c, 0.95)::double as p95, quantile_cont(c, 0.99)::double as p99 from (select count(*) as c from events group by user_id)")
add("agg_08_segment_means", lambda s, d: T(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc")), "select l_returnflag, l_linestatus, round(avg(l_quantity), 6) as qty, round(avg(l_discount), 6) as disc from lineitem group by 1, 2")
add("agg_09_by_class", lambda s, d: T(s, d, "documents").join(T(s, d, "labels"), "doc_id").groupBy("quality").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.median("n_chars").alias("median")), "select quality, round(avg(n_chars), 6) as mean, median(n_chars)::double as median from documents join labels using (doc_id) group by 1")
add("agg_10_conditional_percent", lambda s, d: T(s, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(F.when(F.col("o_totalprice") >= 150000, 1).otherwise(0)) * 100, 6).alias("pct")), "select o_orderpriority, round(avg(case when o_totalprice >= 150000 then 1 else 0 end) * 100, 6) as pct from orders group by 1")
add("agg_11_collect_set", lambda s, d: T(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("seen")), "select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') as seen from orders group by 1")
add("agg_12_weighted_sums", lambda s, d: T(s, d, "events").groupBy("user_id").agg(*[F.round(F.sum(F.when(F.col("event_type") == e, F.col("value")).otherwise(0.0)), 6).alias(e) for e in ("click", "view")]), "select user_id, round(sum(case when event_type = 'click' then value else 0 end), 6) as click, round(sum(case when event_type = 'view' then value else 0 end), 6) as view from events group by 1")
add("agg_13_frequent_tokens", lambda s, d: T(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n >= 50"), "select token, count(*) as n from (select unnest(string_split(p_name, ' ')) as token from part) group by 1 having count(*) >= 50")
add("agg_14_idf_table", lambda s, d: T(s, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(T(s, d, "part").agg(F.count("*").alias("n")))).select("token", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)), 9).alias("idf")), "select token, round(ln((n + 1)::double / (df + 1)), 9) as idf from (select token, count(*) as df from (select distinct p_partkey, unnest(string_split(p_name, ' ')) as token from part) group by 1), (select count(*) as n from part)")
add("agg_15_aligned_shares", lambda s, d: (lambda a, b: a.join(b, "k", "full").select("k", F.round(F.coalesce("a", F.lit(0.0)), 9).alias("a"), F.round(F.coalesce("b", F.lit(0.0)), 9).alias("b")).where("a >= 0.005 or b >= 0.005"))(*[T(s, d, t).groupBy(F.col(c).alias("k")).count().withColumn(n, F.col("count") / F.sum("count").over(Window.partitionBy())).drop("count") for t, c, n in (("customer", "c_nationkey", "a"), ("supplier", "s_nationkey", "b"))]), "with a as (select c_nationkey as k, count(*) / sum(count(*)) over () as a from customer group by 1), b as (select s_nationkey as k, count(*) / sum(count(*)) over () as b from supplier group by 1) select k, round(coalesce(a, 0), 9) as a, round(coalesce(b, 0), 9) as b from a full join b using (k) where coalesce(a, 0) >= 0.005 or coalesce(b, 0) >= 0.005")
add("agg_16_cardinality_histogram", lambda s, d: T(s, d, "orders").groupBy("o_custkey").count().groupBy(F.col("count").alias("orders")).agg(F.count("*").alias("customers")), "select c as orders, count(*) as customers from (select count(*) as c from orders group by o_custkey) group by 1")
add("agg_17_multi_claim", lambda s, d: T(s, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("claims")).where("claims > 1"), "select l_partkey, count(distinct l_orderkey) as claims from lineitem group by 1 having count(distinct l_orderkey) > 1")
add("agg_18_percent_of_total", lambda s, d: T(s, d, "events").groupBy("event_type").count().select("event_type", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()), 6).alias("pct")), "select event_type, round(count(*) * 100.0 / sum(count(*)) over (), 6)::double as pct from events group by 1")

# Scored candidates ----------------------------------------------------------
CAND = {
    "s1_id": "concat('S1-', l_orderkey)",
    "target_id": "concat(case when l_partkey % 3 = 0 then 'S3-' else 'S2-' end, l_partkey)",
    "prob": "((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 1000) / 1000.0e0",
    "label": "case when (l_partkey + l_linenumber) % 4 = 0 then 1 else 0 end",
}
C = "with c as (select s1_id, target_id, max(prob) as prob, max(label)::bigint as label from (select " + ", ".join(f"{e} as {n}" for n, e in CAND.items()) + " from lineitem) group by 1, 2)"
W = "row_number() over (partition by s1_id order by prob desc, target_id)"


def scored(s, d):
    return T(s, d, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in CAND.items()]).groupBy("s1_id", "target_id").agg(F.max("prob").alias("prob"), F.max("label").cast("bigint").alias("label"))


def as_score(s, d):
    return scored(s, d).select("s1_id", "target_id", F.col("prob").alias("score"))


P3 = ("s1_id", "target_id", "prob")
add("win_01_rank", lambda s, d: R.ranked(as_score(s, d)), f"{C} select s1_id, target_id, prob as score, {W} as rank from c")
add("win_02_rank0", lambda s, d: R.ranked(as_score(s, d)).select("s1_id", "target_id", (F.col("rank") - 1).alias("rank0")), f"{C} select s1_id, target_id, {W} - 1 as rank0 from c")
CTX = f"{C}, x as (select *, {W} as rank, max(prob) over (partition by s1_id) as top, count(*) over (partition by s1_id) as size, lead(prob) over (partition by s1_id order by prob desc, target_id) as nxt from c), y as (select *, coalesce(max(case when rank = 2 then prob end) over (partition by s1_id), -1) as second from x)"
add("win_03_top2", lambda s, d: R.group_context(as_score(s, d)).where("rank = 1").select("s1_id", "top", "second"), f"{CTX} select s1_id, top, second from y where rank = 1")
add("win_04_context", lambda s, d: R.group_context(as_score(s, d)).select("s1_id", "target_id", "rank", *[F.round(c, 9).alias(c) for c in ("gap", "ratio", "topgap", "margin_next")], "size"), f"{CTX} select s1_id, target_id, rank, round(top - prob, 9) as gap, round(prob / (top + 1e-6), 9) as ratio, round(top - second, 9) as topgap, round(coalesce(prob - nxt, 0), 9) as margin_next, size from y")
add("win_04b_target_context", lambda s, d: R.group_context(as_score(s, d), "target_id", tie="s1_id", prefix="t_").select("s1_id", "target_id", "t_rank", F.round("t_gap", 9).alias("t_gap")), f"{C} select s1_id, target_id, row_number() over (partition by target_id order by prob desc, s1_id) as t_rank, round(max(prob) over (partition by target_id) - prob, 9) as t_gap from c")
add("win_06_group_size", lambda s, d: scored(s, d).select("s1_id", "target_id", F.count("*").over(Window.partitionBy("s1_id")).alias("n")), f"{C} select s1_id, target_id, count(*) over (partition by s1_id) as n from c")
add("win_07_prefix_sum", lambda s, d: scored(s, d).select("s1_id", "target_id", F.round(F.sum("prob").over(D.by_prob().rowsBetween(Window.unboundedPreceding, 0)), 9).alias("upto")), f"{C} select s1_id, target_id, round(sum(prob) over (partition by s1_id order by prob desc, target_id rows unbounded preceding), 9) as upto from c")
add("win_08_none_true", lambda s, d: scored(s, d).select("s1_id", F.exp(F.sum(F.log1p(-F.least("prob", F.lit(1 - 1e-7)))).over(D.group())).alias("p")).distinct().groupBy("s1_id").agg(F.round(F.max("p") + 5e-10, 6).alias("none")), f"{C} select s1_id, round(exp(sum(ln(1 - least(prob, 1 - 1e-7)))) + 5e-10, 6) as none from c group by 1")
add("win_10_best_owner", lambda s, d: D.one_to_one(scored(s, d)).select(*P3), f"{C} select s1_id, target_id, prob from (select *, row_number() over (partition by target_id order by prob desc, s1_id) as r from c) where r = 1")

add("top_01_global", lambda s, d: T(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice"), "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
add("top_03_head_per_group", lambda s, d: R.ranked(T(s, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey").where("rank <= 3").select("o_custkey", "o_orderkey"), "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3")
add("top_05_fused_cut", lambda s, d: R.ranked(as_score(s, d)).where("rank <= 2").select("s1_id", "target_id"), f"{C} select s1_id, target_id from (select *, {W} as r from c) where r <= 2")
add("top_06_adaptive_cut", lambda s, d: R.adaptive_cut(as_score(s, d), 5).select("s1_id", "target_id", "rank"), f"{CTX} select s1_id, target_id, rank from y where size <= 3 or rank <= case when top >= 0.85 and top - second > 0.35 then 3 else 5 end")
add("top_07_ratio_cut", lambda s, d: R.ratio_cut(as_score(s, d), 0.5, 1, 4).select("s1_id", "target_id", "rank"), f"{CTX} select s1_id, target_id, rank from y where rank <= 1 or (rank <= 4 and prob >= 0.5 * top)")
add("top_08_budget_cut", lambda s, d: R.budget_cut(as_score(s, d), ((0.9, 0.3, 1), (0.7, 0.15, 2), (0.5, 0.0, 3)), 4).select("s1_id", "target_id", "rank"), f"{CTX} select s1_id, target_id, rank from y where rank <= case when top >= 0.9 and top - second >= 0.3 then 1 when top >= 0.7 and top - second >= 0.15 then 2 when top >= 0.5 and top - second >= 0 then 3 else 4 end")
add("top_10_any_rank", lambda s, d: R.any_rank_cut(scored(s, d).withColumn("inv", 1 - F.col("prob")), {"prob": 2, "inv": 1}).select("s1_id", "target_id"), f"{C} select s1_id, target_id from (select *, {W} as a, row_number() over (partition by s1_id order by 1 - prob desc, target_id) as b from c) where a <= 2 or b <= 1")
add("top_11_capped_by_source", lambda s, d: R.capped_by_source(scored(s, d), 2, 3).select(*P3), f"{C} select s1_id, target_id, prob from (select *, {W} as b from (select *, row_number() over (partition by s1_id, substr(target_id, 1, 2) order by prob desc, target_id) as a from c) where a <= 2) where b <= 3")

# Sets -----------------------------------------------------------------------
def parts_of(s, d, flag):
    return T(s, d, "lineitem").where(F.col("l_returnflag") == flag).select("l_partkey")


SA, SB = ("(select l_partkey from lineitem where l_returnflag = '%s')" % f for f in ("A", "R"))
add("set_01_union_all", lambda s, d: T(s, d, "customer").select(F.col("c_name").alias("name")).unionByName(T(s, d, "supplier").select(F.col("s_name").alias("name"))), "select c_name as name from customer union all select s_name from supplier")
add("set_02_union", lambda s, d: parts_of(s, d, "A").union(parts_of(s, d, "R")).distinct(), f"select l_partkey from {SA} union select l_partkey from {SB}")
add("set_04_intersection", lambda s, d: parts_of(s, d, "A").intersect(parts_of(s, d, "R")), f"select l_partkey from {SA} intersect select l_partkey from {SB}")
add("set_05_difference", lambda s, d: parts_of(s, d, "A").subtract(parts_of(s, d, "R")), f"select l_partkey from {SA} except select l_partkey from {SB}")
_ab = lambda s, d: T(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_partkey")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_partkey")))).alias("b"))
AB = "with x as (select l_orderkey, coalesce(list_sort(list(distinct l_partkey) filter (l_returnflag = 'A')), []) as a, coalesce(list_sort(list(distinct l_partkey) filter (l_linestatus = 'O')), []) as b from lineitem group by 1)"
_cnt = lambda c: F.size(c).cast("bigint")
add("set_06_row_difference", lambda s, d: _ab(s, d).select("l_orderkey", _cnt(F.array_union(F.array_except("a", "b"), F.array_except("b", "a"))).alias("n")), f"{AB} select l_orderkey, len(list_filter(a, lambda v: not list_contains(b, v))) + len(list_filter(b, lambda v: not list_contains(a, v))) as n from x")
add("set_07_added_removed", lambda s, d: _ab(s, d).select("l_orderkey", _cnt(F.array_except("b", "a")).alias("added"), _cnt(F.array_except("a", "b")).alias("removed")), f"{AB} select l_orderkey, len(list_filter(b, lambda v: not list_contains(a, v))) as added, len(list_filter(a, lambda v: not list_contains(b, v))) as removed from x")
add("set_08_concat_missing", lambda s, d: T(s, d, "customer").select("c_name", "c_mktsegment").unionByName(T(s, d, "supplier").select(F.col("s_name").alias("c_name")), allowMissingColumns=True), "select c_name, c_mktsegment from customer union all select s_name, null from supplier")
add("set_09_dedup_subset", lambda s, d: R.ranked(T(s, d, "lineitem"), "l_partkey", "l_extendedprice", "l_orderkey").where("rank = 1").select("l_partkey", "l_extendedprice"), "select l_partkey, l_extendedprice from (select *, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey) as r from lineitem) where r = 1")

# Sampling: the samples are the feature --------------------------------------
_h = lambda c: F.md5(F.concat(F.lit("7-"), F.col(c).cast("string")))
add("smp_01_exact_sample", lambda s, d: T(s, d, "customer").orderBy(_h("c_custkey"), "c_custkey").limit(100).select("c_custkey"), "select c_custkey from customer order by md5('7-' || c_custkey), c_custkey limit 100")
add("smp_04_hash_roles", lambda s, d: T(s, d, "customer").select("c_custkey", (F.conv(F.substring(_h("c_custkey"), 1, 8), 16, 10).cast("bigint") % 10000).alias("b")).select("c_custkey", F.when(F.col("b") < 1500, "ranker").when(F.col("b") < 8500, "model").otherwise("holdout").alias("role")), "select c_custkey, case when b < 1500 then 'ranker' when b < 8500 then 'model' else 'holdout' end as role from (select c_custkey, ('0x' || substr(md5('7-' || c_custkey), 1, 8))::bigint % 10000 as b from customer)")
add("smp_06_group_folds", lambda s, d: scored(s, d).select("s1_id", "target_id", (F.conv(F.substring(_h("s1_id"), 1, 8), 16, 10).cast("bigint") % 5).alias("fold")), f"{C} select s1_id, target_id, ('0x' || substr(md5('7-' || s1_id), 1, 8))::bigint % 5 as fold from c")
add("smp_10_quota", lambda s, d: scored(s, d).withColumn("r", F.row_number().over(Window.partitionBy("s1_id").orderBy(_h("target_id"), "target_id"))).where("r <= 2").select("s1_id", "target_id"), f"{C} select s1_id, target_id from (select *, row_number() over (partition by s1_id order by md5('7-' || target_id), target_id) as r from c) where r <= 2")

# Decisions ------------------------------------------------------------------
add("dec_01_threshold", lambda s, d: D.threshold_policy(scored(s, d)).select(*P3), f"{C} select s1_id, target_id, prob from (select *, max(prob) over (partition by s1_id) as top from c) where top >= 0.4 and prob >= 0.72")
TAU = "case when target_id like 'S3-%' then 0.75 else 0.72 end"
add("dec_02_source_thresholds", lambda s, d: D.source_thresholds(scored(s, d)).select(*P3), f"{C} select s1_id, target_id, prob from c where prob >= {TAU}")
LEAD = "top - greatest(second, 0)"
TIER = f"case when top < 0.4 then 'C' when top >= 0.82 and ({LEAD} >= 0.12 or size = 1) then 'A' when top >= 0.68 then case when proof = 1 then 'A' when {LEAD} < 0.05 and top < 0.75 then 'C' else 'B' end else 'C' end"
Z = f"{CTX}, z as (select *, max(case when rank = 1 and label = 1 then 1 else 0 end) over (partition by s1_id) as proof from y), g as (select *, {TIER} as tier from z)"
add("dec_03_singleton_tiers", lambda s, d: D.singleton_tiers(scored(s, d), evidence=F.col("label") == 1).select("s1_id", "target_id", "tier"), f"{Z} select s1_id, target_id, tier from g")
LEG = "select *, row_number() over (partition by s1_id order by f desc, k desc) as best from (select *, round(1.25 * m / (0.25 * m + 1), 12) as f from (select *, row_number() over w as k, sum(prob) over (w rows unbounded preceding) / row_number() over w as m from {src} window w as (partition by s1_id order by prob desc, target_id)))"
add("dec_04_expected_f_legacy", lambda s, d: D.expected_f_legacy(scored(s, d)).select(*P3), f"{C}, e as ({LEG.format(src='c')}) select e.s1_id, target_id, prob from e join (select s1_id, k as bk from e where best = 1) using (s1_id) where k <= bk")
EF = "{C}, q as (select *, row_number() over w as k, sum(p) over (w rows unbounded preceding) as tp, sum(p) over (partition by s1_id) as t, exp(sum(ln(1 - p)) over (partition by s1_id)) as none from (select *, least(prob, 1 - 1e-7) as p from c) window w as (partition by s1_id order by prob desc, target_id)), e as (select *, round(1.25 * tp / (k + 0.25 * t), 12) as f from q), b as (select s1_id, arg_max(k, (f, -k)) as bk, max(f) as bf, max(none) as bn from e group by 1)"
add("dec_11_expected_f", lambda s, d: D.expected_f_select(scored(s, d)).select(*P3), EF.replace("{C}", C) + " select e.s1_id, target_id, prob from e join b using (s1_id) where k <= bk and bf >= bn")
add("dec_07_full_engine", lambda s, d: D.full_engine(scored(s, d), evidence=F.col("label") == 1).select(*P3))
add("dec_08_collisions", lambda s, d: D.resolve_collisions(scored(s, d).where("prob >= 0.5")).select(*P3), f"{C}, v as (select *, row_number() over (partition by target_id order by prob desc, s1_id) as r from c where prob >= 0.5), u as (select *, max(case when r = 1 then prob end) over (partition by target_id) as a, max(case when r = 2 then prob end) over (partition by target_id) as b from v) select s1_id, target_id, prob from u where b is null or round(a - b, 9) < 0.15 or r = 1")
add("dec_09_one_to_one", lambda s, d: D.threshold_policy(D.one_to_one(scored(s, d)), 0.58, 0.0).select(*P3), f"{C} select s1_id, target_id, prob from (select *, row_number() over (partition by target_id order by prob desc, s1_id) as r from c) where r = 1 and prob >= 0.58")
add("dec_10_min_top", lambda s, d: D.threshold_or_best(scored(s, d), 0.8, 0.5).select(*P3), f"{C} select s1_id, target_id, prob from (select *, {W} as r from c) where prob >= 0.8 or (r = 1 and prob >= 0.5)")
add("dec_13_singleton_gate", lambda s, d: D.singleton_gate(scored(s, d), 0.6).select(*P3), f"{C} select s1_id, target_id, prob from (select *, max(prob) over (partition by s1_id) as top from c) where top >= 0.6")
add("dec_15_score_margin", lambda s, d: D.score_margin(scored(s, d), 0.6, 0.05).select(*P3), f"{CTX} select s1_id, target_id, prob from y where prob >= 0.6 and (size = 1 or top - second >= 0.05)")
add("dec_17_singleton_rule", lambda s, d: D.best_or_singleton(scored(s, d)), f"{CTX} select s1_id, (top < 0.4 or (top < 0.6 and top - second < 0.1)) as singleton from y where rank = 1")
add("dec_18_band_route", lambda s, d: D.band_route(scored(s, d), 0.4, 0.8, lambda x: x.withColumn("prob2", F.col("label").cast("double"))).select("s1_id", "target_id", "band", "prob"), f"{C} select s1_id, target_id, case when prob >= 0.8 then 'accept' when prob < 0.4 then 'reject' else 'check' end as band, case when prob >= 0.8 or prob < 0.4 then prob else round(0.5 * prob + 0.5 * label, 9) end as prob from c")
add("dec_19_recovery", lambda s, d: (lambda b: D.recover_unclaimed(b.where("prob >= 0.7").select(*P3), b.where("prob >= 0.5").select(*P3)))(scored(s, d)), f"{C}, n as (select * from c where prob >= 0.7), b as (select * from c where prob >= 0.5), lost as (select * from b where s1_id not in (select s1_id from n)), o as (select target_id, count(distinct s1_id) as owners from b group by 1), x as (select lost.*, owners, target_id in (select target_id from n) as claimed from lost join o using (target_id)) select s1_id, target_id, prob from n union all select s1_id, target_id, prob from x where s1_id not in (select s1_id from x where owners > 1 or claimed)")
add("dec_20_max_merge", lambda s, d: D.max_merge(scored(s, d).select(*P3), scored(s, d).select("s1_id", "target_id", (1 - F.col("prob")).alias("prob"))).select("s1_id", "target_id", F.round("prob", 9).alias("prob")), f"{C} select s1_id, target_id, round(greatest(prob, 1 - prob), 9) as prob from c")

# Evaluation -----------------------------------------------------------------
ids = lambda s, d: T(s, d, "orders").select(F.concat(F.lit("S1-"), F.col("o_orderkey")).alias("s1_id"))
pred = lambda s, d: scored(s, d).where("prob >= 0.6")
true = lambda s, d: scored(s, d).where("label = 1")
REC = f"{C}, r as (select s1_id, sum((prob >= 0.6 and label = 1)::int)::bigint as tp, sum((prob >= 0.6)::int)::bigint as n_pred, sum((label = 1)::int)::bigint as n_true from c group by 1), v as (select i.s1_id, coalesce(tp, 0) as tp, coalesce(n_pred, 0) as n_pred, coalesce(n_true, 0) as n_true from (select distinct concat('S1-', o_orderkey) as s1_id from orders) i left join r using (s1_id)), w as (select *, case when n_pred + n_true = 0 then 1 else 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + (n_pred - tp)) end as f from v)"
add("eval_01_f_beta", lambda s, d: T(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(E.f_beta(F.col("l_discount") * 10, F.col("l_tax") * 12), 9).alias("f")), "select l_orderkey, l_linenumber, round(case when p + r > 0 then 1.25 * p * r / (0.25 * p + r) else 0 end, 9) as f from (select *, l_discount * 10 as p, l_tax * 12 as r from lineitem)")
add("eval_02_macro_f05", lambda s, d: E.macro_f05(ids(s, d), pred(s, d), true(s, d)), f"{REC} select round(avg(f), 9) as macro_f05, round(sum(tp) / sum(n_pred), 9)::double as precision, round(sum(tp) / sum(n_true), 9)::double as recall, count(case when n_pred + n_true = 0 then 1 end) as singletons_kept, count(*) as records from w")
add("eval_03_per_record_f", lambda s, d: E.per_record(ids(s, d), pred(s, d), true(s, d)).withColumn("f05", F.round("f05", 9)), f"{REC} select s1_id, tp, n_pred, n_true, round(f, 9)::double as f05 from w")
add("eval_04_candidate_quality", lambda s, d: E.candidate_quality(ids(s, d), T(s, d, "part"), pred(s, d), true(s, d)), f"{REC} select sum(n_pred)::bigint as pairs, sum(tp)::bigint as hits, round(sum(tp) / sum(n_true), 9)::double as recall, round(avg(n_pred), 9) as mean, quantile_cont(n_pred, 0.95)::double as p95, max(n_pred) as most, round(1 - sum(n_pred)::double / (count(*)::double * (select count(*) from part)), 12) as reduction from w")
add("eval_05_recall_at_k", lambda s, d: E.recall_at(R.ranked(scored(s, d), score="prob"), true(s, d), [1, 2, 3, 5]), f"{C}, r as (select *, {W} as rank from c) select k, count(*) as hits, round(count(*) / (select count(*) from c where label = 1), 9) as recall from (select unnest([1, 2, 3, 5]) as k) join r on rank <= k and label = 1 group by 1")
add("eval_06_oracle_ceiling", lambda s, d: E.macro_f05(ids(s, d), R.ranked(scored(s, d), score="prob").where("rank <= 2 and label = 1"), true(s, d)).select("macro_f05", "recall"), f"{C}, r as (select *, {W} as rank from c), x as (select s1_id, sum((rank <= 2 and label = 1)::int) as tp, sum(label) as t from r group by 1), y as (select i.s1_id, coalesce(tp, 0) as tp, coalesce(t, 0) as t from (select distinct concat('S1-', o_orderkey) as s1_id from orders) i left join x using (s1_id)) select round(avg(case when t = 0 then 1 else 1.25 * tp / (1.25 * tp + 0.25 * (t - tp)) end), 9) as macro_f05, round(sum(tp) / sum(t), 9)::double as recall from y")
add("eval_07_segments", lambda s, d: E.per_record(ids(s, d), pred(s, d), true(s, d)).withColumn("segment", F.explode(F.array(F.lit("all"), F.when(F.col("n_true") == 0, "singleton").when(F.col("n_true") == 1, "one").otherwise("many")))).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.avg("f05"), 9).alias("f05")), f"{REC}, s as (select f, unnest(['all', case when n_true = 0 then 'singleton' when n_true = 1 then 'one' else 'many' end]) as segment from w) select segment, count(*) as n, round(avg(f), 9) as f05 from s group by 1")
add("eval_08_threshold_sweep", lambda s, d: E.threshold_sweep(scored(s, d), [0.2, 0.4, 0.6, 0.8]).select("threshold", "n", "tp", "precision", "f05"), f"{C} select t as threshold, count(*) as n, sum(label)::bigint as tp, round(sum(label) / count(*), 9)::double as precision, round(1.25 * sum(label) / (1.25 * sum(label) + 0.25 * ((select sum(label) from c) - sum(label)) + count(*) - sum(label)), 9)::double as f05 from (select unnest([0.2, 0.4, 0.6, 0.8]::double[]) as t) join c on prob >= t group by 1")
add("eval_11_policy_grid", lambda s, d: E.policy_grid(scored(s, d), [0.5, 0.7], [0.0, 0.1]), f"{CTX} select t as threshold, m as margin, count(*) as n, sum(label)::bigint as tp from y, (select unnest([0.5, 0.7]::double[]) as t), (select unnest([0.0, 0.1]::double[]) as m) where prob >= t and top - second >= m group by 1, 2")
add("eval_12_missed_causes", lambda s, d: R.ranked(scored(s, d), score="prob").where("label = 1 and prob < 0.6").select(F.when(F.col("rank") > 3, "ranked low").when(F.col("prob") < 0.2, "no evidence").when(F.col("target_id").startswith("S3-"), "source 3").otherwise("near threshold").alias("cause")).groupBy("cause").agg(F.count("*").alias("n")), f"{C} select case when r > 3 then 'ranked low' when prob < 0.2 then 'no evidence' when target_id like 'S3-%' then 'source 3' else 'near threshold' end as cause, count(*) as n from (select *, {W} as r from c) where label = 1 and prob < 0.6 group by 1")
add("eval_14_output_contract", lambda s, d: E.output_contract(ids(s, d), pred(s, d).select("s1_id", "target_id"), scored(s, d)), f"{C}, m as (select * from c where prob >= 0.6) select 'missing' as check, count(*) as bad from orders where concat('S1-', o_orderkey) not in (select s1_id from m) union all select 'not_candidate', 0 union all select 'repeated', 0")
add("eval_15_separation", lambda s, d: E.separation(T(s, d, "documents").join(T(s, d, "labels"), "doc_id"), "n_chars", "quality"), "with x as (select n_chars as s, quality as y from documents join labels using (doc_id)), g as (select s, sum(y) as p, count(*) - sum(y) as n from x group by 1), h as (select *, sum(p) over (order by s) as cp, sum(n) over (order by s) as cn, sum(p) over () as tp, sum(n) over () as tn from g) select round(sum(p * (cn - n / 2.0)) / (max(tp) * max(tn)), 9)::double as auc, round(max(abs(cp / tp - cn / tn)), 9)::double as ks from h")
add("eval_16_margin_by_cardinality", lambda s, d: R.group_context(scored(s, d), score="prob").where("rank = 1").groupBy("size").agg(F.count("*").alias("n"), F.round(F.avg("topgap"), 9).alias("margin")), f"{CTX} select size, count(*) as n, round(avg(top - second), 9) as margin from y where rank = 1 group by 1")
add("eval_17_view_comparison", lambda s, d: A.truth(s, d).join(left(s, d).select("s1_id", F.col("name").alias("na")), "s1_id").join(right(s, d).select("target_id", F.col("name").alias("nb")), "target_id").agg(F.count_if(F.col("na") == F.col("nb")).alias("exact"), F.count_if(F.replace("na", F.lit(" "), F.lit("")) == F.replace("nb", F.lit(" "), F.lit(""))).alias("compact"), F.count("*").alias("n")), f"{K} select count(case when l.name = t.name then 1 end) as exact, count(case when replace(l.name, ' ', '') = replace(t.name, ' ', '') then 1 end) as compact, count(*) as n from truth join l using (s1_id) join t using (target_id)")
add("eval_18_channel_comparison", lambda s, d: (lambda l, r, t: B.exact_block(l, r, ["country", "name"]).withColumn("channel", F.lit("name")).unionByName(B.exact_block(l, r, ["country", "postal"]).withColumn("channel", F.lit("postal"))).join(t.withColumn("hit", F.lit(1)), ["s1_id", "target_id"], "left").groupBy("channel").agg(F.count("*").alias("pairs"), F.count("hit").alias("hits")))(left(s, d), right(s, d), A.truth(s, d)), f"{K}, p as (select 'name' as channel, s1_id, target_id from l join t on l.country = t.country and l.name = t.name where l.name <> '' union all select 'postal', s1_id, target_id from l join t on l.country = t.country and l.postal = t.postal where l.postal <> '') select channel, count(*) as pairs, count(u.s1_id) as hits from p left join truth u on u.s1_id = p.s1_id and u.target_id = p.target_id group by 1")
add("eval_20_profile", lambda s, d: A.s1(s, d).unionByName(A.targets(s, d)).groupBy(F.substring("entity_id", 1, 2).alias("source"), "country").agg(F.count("*").alias("n"), F.count_if(X.clean_missing(F.col("business_address")) == "").alias("no_address")), f"with {A.RECORDS} select substr(entity_id, 1, 2) as source, country, count(*) as n, count(case when coalesce(business_address, '') = '' then 1 end) as no_address from (select * from s1 union all select * from targets) group by 1, 2")
