"""Registered queries: bounded retrieval, learned components, model stages, plug-in functions, further oracles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import blocking as B
from ..operators import bundle
from ..operators import evaluate as E
from ..operators import features as P
from ..operators import model as M
from ..sources import io
from ..sources.schema import SOURCE
from ..streaming import stream
from . import adapters as A
from .match_queries import JAC, LEV, NUMERIC, PQ, labelled, names_of, pairs_of, training
from .relational_queries import C, K, PAIR, left, right, scored
from .text_queries import every, s_token, s_tokens, s_words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T = A.table


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


# Sources -------------------------------------------------------------------------
def written_tsv(s, d):
    path = io.work_path(s, "s1.tsv")
    io.write_tsv(A.s1(s, d), path)
    return path


def raw_fields(s, d):
    """Every record as a map of its fields, read with a limit that the file stays under."""
    x = io.scan_raw(s, written_tsv(s, d), 100_000_000)
    fields = x.select(F.create_map(*[y for c in SOURCE.fieldNames() for y in (F.lit(c), F.col(c))]).alias("r"))
    return fields.select(*[F.col("r")[c].alias(c) for c in SOURCE.fieldNames()])


def discovered(s, d):
    """Files by name in any case, wherever below the folder they are."""
    path = io.work_path(s, "tree")
    for place in ("a/Train_Source1", "b/c/TRAIN_SOURCE1", "b/other"):
        T(s, d, "region").select("r_name").coalesce(1).write.text(f"{path}/{place}")
    found = s.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    folder = F.element_at(F.split("path", "/"), -2)
    return found.where(F.lower(folder) == "train_source1").select(folder.alias("name"))


add("src_02_raw_fields", raw_fields, f"with {A.RECORDS} select entity_id, business_name, coalesce(business_address, '') as business_address, country from s1")
add("src_10_discovered_files", discovered, "select * from (values ('Train_Source1'), ('TRAIN_SOURCE1')) t(name)")


# Features ------------------------------------------------------------------------
def oov(s, d):
    """Share and number of a target's name words that no reference name of its country has, and whether all are such."""
    known = names_of(s, d, A.S1, "s1_id").select("country", F.explode(X.tokens(F.col("n"))).alias("w")).distinct().withColumn("known", F.lit(1))
    x = names_of(s, d, A.S3, "target_id").select("target_id", "country", F.explode(X.tokens(F.col("n"))).alias("w")).join(known, ["country", "w"], "left")
    new = F.count_if(F.col("known").isNull())
    return x.groupBy("target_id").agg(F.round(new / F.count("*"), 9).alias("oov_share"), new.alias("oov_count"), (new == F.count("*")).alias("all_oov"))


def proxy_scores(s, d):
    """Training pairs that no retrieval found get the likeness of their names as score."""
    found = B.fuse([(B.exact_block(left(s, d), right(s, d), ["country", "name"]), 1.0), (B.exact_block(left(s, d), right(s, d), ["country", "postal", "house"]), 0.5)])
    x = P.with_features(labelled(s, d), ["name_jaccard"]).select("s1_id", "target_id", "label", "name_jaccard")
    x = x.join(found.select("s1_id", "target_id", "score"), ["s1_id", "target_id"], "left")
    return x.select("s1_id", "target_id", "label", F.round(F.coalesce("score", "name_jaccard"), 9).alias("score"))


add(
    "feat_40_oov_words", oov,
    f"with {A.RECORDS}, v as (select distinct upper(country) as country, unnest({s_tokens(s_token('business_name'))}) as w from s1), q as (select entity_id as target_id, upper(country) as country, unnest({s_tokens(s_token('business_name'))}) as w from s3) "
    "select target_id, round(count(case when v.w is null then 1 end)::double / count(*), 9) as oov_share, count(case when v.w is null then 1 end) as oov_count, count(v.w) = 0 as all_oov from q left join v using (country, w) group by 1",
)
add(
    "feat_44_proxy_scores", proxy_scores,
    f"{PQ}, f as (select s1_id, target_id, max(sc) as sc from (select s1_id, target_id, 1.0 as sc from l join t on l.country = t.country and l.name = t.name where l.name <> '' union all select s1_id, target_id, 0.5 from l join t on l.country = t.country and l.postal = t.postal and l.house = t.house where l.house <> '') group by 1, 2) "
    f"select p.s1_id, p.target_id, (u.s1_id is not null)::int as label, round(coalesce(f.sc::double, {JAC('tna', 'tnb')}), 9) as score from p left join truth u on u.s1_id = p.s1_id and u.target_id = p.target_id left join f on f.s1_id = p.s1_id and f.target_id = p.target_id",
)
ORACLES["feat_21_strength_conflicts"] = f"{PQ} select s1_id, target_id, (jaro_winkler_similarity(na, nb) >= 0.88 and jaro_winkler_similarity(aa, ab) < 0.35)::int as name_strong_addr_weak, (jaro_winkler_similarity(na, nb) < 0.60 and jaro_winkler_similarity(aa, ab) >= 0.85)::int as name_weak_addr_strong from p"
ORACLES["feat_30_weighted_jaccard"] = (
    f"{PQ}, e as (select * from s1 union all select * from targets), w as (select token, count(*) as df from (select entity_id, unnest(list_distinct({s_tokens(s_token('business_name'))})) as token from e) group by 1), n as (select count(*) as n from e), "
    "i as (select token, ln((n + 1)::double / (df + 1)) as idf from w, n), x as (select s1_id, target_id, tna, tnb, unnest(list_distinct(list_concat(tna, tnb))) as token from p) "
    "select s1_id, target_id, round(sum(case when list_contains(tna, token) and list_contains(tnb, token) then idf else 0 end) / sum(idf), 6) as weighted_jaccard from x join i using (token) group by 1, 2"
)
FIRST = lambda c: f"list_slice({s_tokens(c)}, 1, 1)"
ORACLES["join_27_hard_negatives"] = (
    f"{K}, i as (select * from (select target_id, country, token, row_number() over (partition by country, token order by target_id) as rn from (select distinct target_id, country, unnest({FIRST('name')}) as token from t) where length(token) >= 1) where rn <= 5), "
    f"q as (select distinct s1_id, country, unnest({FIRST('name')}) as token from l), m as (select distinct s1_id, target_id from q join i using (country, token)) "
    "select s1_id, target_id from m where (s1_id, target_id) not in (select s1_id, target_id from truth)"
)


# Learned components --------------------------------------------------------------
def placed(df):
    """Reference-like addresses that end in their country, so that there is something to learn."""
    return df.withColumn("business_address", F.concat_ws(", ", "business_address", "country"))


def renormalised(s, d):
    ref, pool = placed(A.s1(s, d)), placed(A.targets(s, d))
    learned = bundle.learned_components(ref, pool)
    return bundle.without_components(pool, learned).select("entity_id", X.token_normalize(F.col("business_address")).alias("address"))


PART = lambda x: f"lower(regexp_replace({x}, '^[\\s.]+|[\\s.]+$', '', 'g'))"
PLACED = f"with {A.RECORDS}, r as (select entity_id, country, concat_ws(', ', business_address, country) as a from s1), o as (select entity_id, country, concat_ws(', ', business_address, country) as a from targets)"
SHARE = "(select country, {part} as part, count(*)::double / sum(count(*)) over (partition by country) as share from {rel} group by 1, 2)"
LAST = PART("string_split(coalesce(a, ''), ',')[-1]")
add(
    "lrn_05_learned_components", renormalised,
    f"{PLACED}, k as (select country, part from (select country, part, coalesce(x.share, 0) as x, coalesce(y.share, 0) as y from {SHARE.format(part=LAST, rel='r')} x full join {SHARE.format(part=LAST, rel='o')} y using (country, part)) where (x >= 0.005 or (y >= 0.005 and x < y / 10)) and part <> '' and not regexp_matches(part, '[0-9]')), "
    f"g as (select country, list(part) as gone from k group by 1), n as (select entity_id, array_to_string(list_filter(string_split(a, ','), lambda p: not list_contains(coalesce(gone, []::varchar[]), {PART('p')})), ',') as business_address from o left join g using (country)) "
    f"select entity_id, {s_token('business_address')} as address from n",
)


# Models and their stages ---------------------------------------------------------
def early_stopped(s, d):
    x = training(s, d)
    return M.predict(M.fit_until_worse(x, NUMERIC, 8), x).select("s1_id", "target_id", "label", "prob")


def staged_model(s, d):
    """Trained where no model is, then loaded: both give the same probabilities, so no row differs."""
    x, path = training(s, d), io.work_path(s, "staged")
    first = M.predict(M.model_for(s, path, "train", x, NUMERIC, M.logistic()), x).select("s1_id", "target_id", F.col("prob").alias("p1"))
    again = M.predict(M.model_for(s, path, "test", x, NUMERIC, M.logistic()), x).select("s1_id", "target_id", F.col("prob").alias("p2"))
    return first.join(again, ["s1_id", "target_id"]).select("s1_id", "target_id", (F.col("p1") == F.col("p2")).alias("same"))


add("ml_09_early_stopping", early_stopped)
add("ml_13_model_or_train", staged_model, f"{PQ} select s1_id, target_id, true as same from p")
add(
    "eval_15b_average_precision", lambda s, d: E.average_precision(scored(s, d), "prob", "label").crossJoin(E.brier(scored(s, d), "prob", "label")),  # one row each
    f"{C}, g as (select prob, sum(label) as p, count(*) as n from c group by 1), h as (select *, sum(p) over (order by prob desc) as cp, sum(n) over (order by prob desc) as cn, sum(p) over () as tp from g), a as (select round(sum(p / tp * cp / cn), 9)::double as pr_auc from h) select pr_auc, (select round(avg((prob - label) * (prob - label)), 9) from c) as brier from a",
)


# Bounded retrieval ---------------------------------------------------------------
def chunked_counts(s, d):
    """Counters fed by files that arrive one at a time, as a stream with complete results."""
    path = io.work_path(s, "chunks")
    T(s, d, "events").select("event_type", "value").repartition(4, "value").write.parquet(path)
    rows = s.readStream.schema("event_type string, value double").option("maxFilesPerTrigger", 1).parquet(path)
    return stream.run_to_end(s, rows.groupBy("event_type").agg(F.count("*").alias("n")), "counts", "complete")


add("stm_03_query_parts", lambda s, d: B.exact_block(B.in_parts(left(s, d), 5000), right(s, d), ["country", "name"], shortest=3), f"{PAIR} l.name = t.name where length(l.name) > 2")
add("stm_04_chunked_counts", chunked_counts, "select event_type, count(*) as n from events group by 1")
add(
    "stm_05_budgeted_join",
    lambda s, d: B.budgeted_join(T(s, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey"), T(s, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), ["k"], 5000).groupBy("k").agg(F.count("*").alias("pairs"), F.sum("c_custkey").alias("customers"), F.sum("s_suppkey").alias("suppliers")),
    "select s_nationkey as k, count(*) as pairs, sum(c_custkey)::bigint as customers, sum(s_suppkey)::bigint as suppliers from supplier join customer on s_nationkey = c_nationkey group by 1",
)


# Plug-in functions ---------------------------------------------------------------
#: Views by name: any function of a column fits.
VIEWS = {"raw": lambda c: c, "token": X.token_normalize, "compact": lambda c: F.replace(X.token_normalize(c), F.lit(" "), F.lit("")), "upper": F.upper}


def viewed(s, d):
    """Distinct names under every view."""
    x = every(s, d).select(*[f(F.col("business_name")).alias(n) for n, f in VIEWS.items()])
    return x.agg(*[F.count_distinct(n).alias(n) for n in VIEWS])


def counters(s, d):
    """Counters with a state that is updated by row and merged by partial aggregation: totals, hits and a running best."""
    return scored(s, d).groupBy("s1_id").agg(F.count("*").alias("seen"), F.sum("label").alias("hits"), F.max(F.struct("prob", F.col("target_id").alias("at")))["prob"].alias("best"))


def mapped_chunks(s, d):
    """A function of Arrow batches on every partition, with a shared table broadcast to the workers."""
    names = s.sparkContext.broadcast({r["n_nationkey"]: r["n_name"] for r in T(s, d, "nation").collect()})  # 25 rows

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names.value.get(k) for k in b.column(1).to_pylist()], pa.string())], names=["c_custkey", "nation"])

    schema = T(s, d, "customer").select("c_custkey").schema.add("nation", "string")
    return T(s, d, "customer").select("c_custkey", "c_nationkey").mapInArrow(run, schema)


add("udf_02_views", viewed, f"with {A.RECORDS}, e as (select business_name as n from s1 union all select business_name from targets) select count(distinct n) as raw, count(distinct {s_token('n')}) as token, count(distinct replace({s_token('n')}, ' ', '')) as compact, count(distinct upper(n)) as upper from e")
add("udf_04_counters", counters, f"{C} select s1_id, count(*) as seen, sum(label)::bigint as hits, max(prob) as best from c group by 1")
add("udf_06_mapped_chunks", mapped_chunks, "select c_custkey, n_name as nation from customer left join nation on c_nationkey = n_nationkey")


# Oracles of retrieval within countries ---------------------------------------------
def retrieval_sql(records, query, target, k, least=0.0, max_df=1.0, top=None, joint=False, out="s1_id, target_id, round(score, 6) as score, rank"):
    """Retrieval in SQL; ``query`` and ``target`` are selections of (id, country, terms)."""
    counts = lambda rel: f"(select id, country, term, count(*) as tf from (select id, country, unnest(terms) as term from ({rel})) group by 1, 2, 3)"
    ids = f"select id, country from ({target})" + (f" union all select id, country from ({query})" if joint else "")
    seen = "select * from tc" + (" union all select * from qc" if joint else "")

    def unit(rel):
        x = f"(select id, country, term, (1 + ln(tf)) * idf as w from {rel} join idf using (country, term))"
        if top is not None:
            x = f"(select * from (select *, row_number() over (partition by id order by w desc, term) as rn from {x}) where rn <= {top})"
        return f"(select id, country, term, w / sqrt(sum(w * w) over (partition by id)) as w from {x})"

    return f"""with {records}, qc as {counts(query)}, tc as {counts(target)}, n as (select country, count(distinct id) as n from ({ids}) group by 1),
      idf as (select country, term, ln((1 + n)::double / (1 + df)) + 1 as idf from (select country, term, count(*) as df from ({seen}) group by 1, 2) join n using (country) where df <= {max_df} * n),
      p as (select a.id as s1_id, b.id as target_id, round(sum(a.w * b.w), 9) as score from {unit('qc')} a join {unit('tc')} b using (country, term) group by 1, 2 having round(sum(a.w * b.w), 9) > {least}),
      r as (select *, row_number() over (partition by s1_id order by score desc, target_id) as rank from p)
      select {out} from r where rank <= {k}"""


def chosen(rel, terms, where="true"):
    """(id, country, terms) of a relation, ``n`` and ``a`` being its cleaned name and address."""
    return f"select id, country, {terms} as terms from (select entity_id as id, upper(country) as country, {s_token('business_name')} as n, {s_token('business_address')} as a from {rel}) where {where}"


def gram_sql(c, low, high):
    one = lambda m: f"list_transform(range(1, greatest(length(t) + 2 - {m} + 1, 1) + 1), lambda i: substr(' ' || t || ' ', i, {m}))"
    return f"flatten(list_transform({s_tokens(c)}, lambda t: flatten([{', '.join(one(m) for m in range(low, high + 1))}])))"


PLAIN = "s1_id, target_id, rank"
ORACLES["ir_03_char_tfidf_address"] = retrieval_sql(A.RECORDS, chosen("s1", gram_sql("a", 3, 4)), chosen("s2", gram_sql("a", 3, 4)), 5, max_df=0.25)
ORACLES["ir_04_joint_char_tfidf"] = retrieval_sql(A.RECORDS, chosen("s1", gram_sql("n", 3, 5)), chosen("s2", gram_sql("n", 3, 5)), 5, max_df=0.5, joint=True, out=PLAIN)
ORACLES["ir_05_pruned_vectors"] = retrieval_sql(A.RECORDS, chosen("s1", gram_sql("a", 3, 4)), chosen("s2", gram_sql("a", 3, 4)), 5, max_df=0.1, top=16)
ORACLES["ir_15_missing_address_channel"] = retrieval_sql(A.RECORDS, chosen("s1", "string_split(n, ' ')"), chosen("s2", "string_split(n, ' ')", "a = ''"), 5, 0.40, out=PLAIN)
STATED = f"string_split({s_words(s_token(chr(39) + chr(39) + ' || n || ' + chr(39) + ' ' + chr(39) + ' || a'), X.STATES)}, ' ')"
ORACLES["ir_16_state_expanded_channel"] = retrieval_sql(A.RECORDS, chosen("s1", STATED), chosen("s3", STATED), 10, 0.30, out=PLAIN)
ONE = lambda i, rel: f"select {i} as id, '' as country, list_distinct({s_tokens(s_token('text'))}) as terms from {rel}"
ORACLES["ir_13_rare_tokens"] = retrieval_sql("one as (select 1)", ONE("item_id", "benchmark"), ONE("doc_id", "documents"), 10, max_df=0.02, top=10, out=PLAIN)
LEXICAL = f"0.70 * jaro_winkler_similarity(na, nb) + 0.30 * ({LEV('na', 'nb')})"
PLACE = f"0.50 * jaro_winkler_similarity(aa, ab) + 0.50 * ({JAC('taa', 'tab')})"
ORACLES["ir_12_lexical_rerank"] = (
    f"{PQ}, f as (select s1_id, target_id, count(distinct c) as votes from (select 0 as c, s1_id, target_id from l join t on l.country = t.country and l.name = t.name where l.name <> '' union all select 1, s1_id, target_id from l join t on l.country = t.country and l.addr = t.addr where length(l.addr) >= 6 "
    "union all select 2, s1_id, target_id from l join t on l.country = t.country and l.postal = t.postal and l.house = t.house where l.house <> '') group by 1, 2), "
    f"a as (select p.*, coalesce(votes, 0) as votes, case when aa <> '' and ab <> '' then 0.60 * ({LEXICAL}) + 0.40 * ({PLACE}) else {LEXICAL} end as x from p left join f using (s1_id, target_id)), "
    "b as (select *, case when na = nb and na <> '' then least(1.0, x + 0.15) else x end as y from a), c as (select *, case when pa = pb and pa <> '' then least(1.0, y + 0.08) else y end as z from b), "
    "e as (select s1_id, target_id, round((case when votes >= 3 then least(1.0, z + 0.05) else least(1.0, z) end)::double, 6) as score from c) "
    "select s1_id, target_id, rank, score from (select *, row_number() over (partition by s1_id order by score desc, target_id) as rank from e) where rank <= 3"
)
