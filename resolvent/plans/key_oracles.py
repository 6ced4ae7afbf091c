"""SQL of sound and skeleton keys, cleaners, number relations, weighted keys and what is learned from them.

DuckDB's patterns know neither back references nor looking around, so repeated
letters and dotted abbreviations are found by position.
"""

from __future__ import annotations

from ..functions import keys as Y
from ..functions import text as X
from . import adapters as A
from .extra_queries import ORACLES as EXTRA
from .extra_queries import chosen, gram_sql, retrieval_sql
from .match_queries import JAC, PQ
from .match_queries import ORACLES as MATCH
from .relational_queries import CTX, C, K, PAIR, W
from .text_queries import _Q, ALL, FLAGS, ONE_WORD_ADDR, s_business, s_dba, s_fold, s_legal, s_sorted, s_token, s_tokens, s_words

ORACLES: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    ORACLES[name] = f"{ALL} select entity_id, {sql} as value from r"


def s_replaced(x, pairs):
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def s_once(words, also="false"):
    """Words without repeats of a letter; ``also`` keeps further characters c."""
    return f"list_transform({words}, lambda v: array_to_string(list_filter(string_split(v, ''), lambda c, i: i = 1 or c <> substr(v, i - 1, 1) or {also}), ''))"


def s_consonants(words, gone):
    """Words of their first letter and what of the rest is not in ``gone``."""
    return s_once(f"list_transform({words}, lambda u: substr(u, 1, 1) || regexp_replace(substr(u, 2), '[{gone}]', '', 'g'))")


def s_phonetic(x):
    """``phonetic_skeleton`` of a normalised text, as words."""
    t = s_replaced("t", (("ph", "f"), ("wr", "r"), ("kn", "n"), ("ksh", "ks"), ("x", "ks")))
    for a, b in (("[ckq]", "k"), ("[zs]", "s"), ("[dt]", "t")):
        t = f"regexp_replace({t}, '{a}', '{b}', 'g')"
    return s_consonants(f"list_transform(list_slice({s_tokens(x)}, 1, 5), lambda t: {t})", "aeiouy")


def s_skeleton(words):
    return s_consonants(f"list_transform({words}, lambda t: {s_replaced('t', Y.DIGRAPHS)})", "aeiouyh")


def s_sounds(x):
    """``sound_set`` of a normalised text."""
    return s_sorted(f"list_filter({s_skeleton(s_tokens(x))}, lambda t: length(t) >= 2)")


def joined(words):
    return f"array_to_string({words}, ' ')"


N = s_token("business_name")
# The records' names are Latin, so romanising them is folding them.
view("str_08_transliterate", s_fold("business_name"))
view("str_13_legal_after_romanizing", s_legal(s_fold("business_name")))
view("str_19_dba_and_domain", s_dba("business_name"))
view("str_19b_dba_and_domain_strict", s_dba("business_name").replace(X.DOMAIN, X.DOMAIN + "\\b").replace(X.DBA, X.DBA_STRICT))
view("str_31_phonetic_skeleton", joined(s_phonetic(N)))
view("str_32_skeleton", joined(s_skeleton(s_tokens(N))))
view("str_33_sound_set", joined(s_sounds(N)))
view("str_34_phonetic_clean", s_once(f"[{s_replaced(N, (*Y.LONG_VOWELS, *Y.DIGRAPHS))}]", "not regexp_full_match(c, '[a-z]')") + "[1]")
view("str_38_stem_key", joined(s_skeleton(f"list_transform({s_tokens(N)}, lambda t: case when length(t) > 3 and suffix(t, 's') and not suffix(t, 'ss') then left(t, -1) else t end)")))
view("str_44_strip_country", f"(select {joined('list_filter(n, lambda t, i: not list_contains(c, t) and list_position(n, t) = i)')} from (select {s_tokens(N)} as n, {s_tokens(s_token('country'))} as c))")

CODES = {**{v: k for k, v in X.STATES.items()}, **{k: k for k in X.STATES}}
STATE = f"list_filter(list_transform(string_split(coalesce(business_address, ''), ','), lambda p: case {s_token('p')} {' '.join(f"when '{k}' then '{v}'" for k, v in CODES.items())} end), lambda s: s is not null)"
view("str_36_state", f"array_to_string({STATE}, ',')")
quoted = lambda words: "'[' || array_to_string(list_transform(" + words + ", lambda q: '\"' || q || '\"'), ',') || ']'"
NUMBERS = f"list_filter({s_tokens(ONE_WORD_ADDR)}, lambda t: regexp_full_match(t, '[0-9]+'))"
WORDS = f"list_filter({s_tokens(ONE_WORD_ADDR)}, lambda t: not regexp_matches(t, '^[0-9]') and not list_contains({_Q(X.STOPWORDS)}, t))"
view("str_18_address_parser", f"'{{\"numbers\":' || {quoted(NUMBERS)} || ',\"words\":' || {quoted(WORDS)} || coalesce(',\"state\":\"' || ({STATE})[-1] || '\"', '') || '}}'")

TAGGED = "regexp_replace(coalesce(business_name, ''), '(?i)[\\[(]\\s*id\\s*[:#]?\\s*[0-9]+\\s*[\\])]', ' ', 'g')"
alone = lambda near, far: f"regexp_full_match(substr(v, {near}, 1), '[A-Za-z]') and not regexp_full_match(substr(v, {far}, 1), '[A-Za-z0-9_]')"
UNDOTTED = f"list_transform([{s_replaced(TAGGED, (('&', ' and '), ('+', ' and '), ('@', ' at ')))}], lambda v: array_to_string(list_filter(string_split(v, ''), lambda c, i: not (c = '.' and {alone('i - 1', 'i - 2')} and {alone('i + 1', 'i + 2')})), ''))[1]"
view("str_20_base_clean", s_token(f"regexp_replace({UNDOTTED}, '[''’`]', '', 'g')"))

HOUSE = "coalesce(list_filter(list_slice(t, 1, 6), lambda x: regexp_full_match(x, '[0-9]{1,5}') or (regexp_matches(x, '[0-9]') and length(x) <= 6))[1], '')"
POSTAL = "coalesce(list_filter(t, lambda x: regexp_full_match(x, '[0-9]{5,6}'))[-1], '')"
ORACLES["str_51_record_views"] = (
    f"with {A.RECORDS}, v as (select entity_id, {s_business('business_name')} as norm_name, {ONE_WORD_ADDR} as norm_addr, upper({s_token('country')}) as country_key from s1), w as (select *, {s_tokens('norm_addr')} as t, {s_tokens('norm_name')} as u from v) "
    f"select entity_id, norm_addr, country_key, {HOUSE} as house_number, {POSTAL} as postal_code, {joined(s_sorted("list_filter(list_concat(t, u), lambda x: regexp_matches(x, '[0-9]'))"))} as numbers, (length(norm_addr) > 0)::int::double as has_addr, "
    f"norm_name, replace({s_token('norm_name')}, ' ', '') as compact_name, {joined(s_phonetic(s_token('norm_name')))} as phonetic, trim(norm_name || ' ' || norm_addr) as norm_full from w"
)

# Numbers, sounds and spelling ------------------------------------------------------
NUM = lambda c: f"list_filter({s_tokens(c)}, lambda t: regexp_full_match(t, '[0-9]+'))"
some = lambda test: f"len(list_filter(less, lambda x: len(list_filter(more, lambda y: {test})) > 0)) > 0"
ORACLES["feat_33_number_relation"] = (
    f"{PQ}, a as (select s1_id, target_id, list_distinct({NUM('aa')}) as a, list_distinct({NUM('ab')}) as b from p), d as (select *, list_filter(a, lambda x: not list_contains(b, x)) as less, list_filter(b, lambda y: not list_contains(a, y)) as more from a) "
    "select s1_id, target_id, case when len(a) = 0 and len(b) = 0 then 'none' when len(a) = 0 then 'missing left' when len(b) = 0 then 'missing right' when len(less) = 0 and len(more) = 0 then 'equal' when len(less) = 0 then 'subset' when len(more) = 0 then 'superset' "
    f"when len(less) < len(a) then 'overlap' when {some('contains(x, y) or contains(y, x)')} then 'part' when {some('levenshtein(x, y) <= 1')} then 'near' else 'different' end as relation from d"
)
ORACLES["feat_35_closest_delta"] = (
    f"{PQ}, x as (select s1_id, target_id, unnest({NUM('aa')}) as x, {NUM('ab')} as b from p), y as (select s1_id, target_id, x, unnest(b) as y from x), "
    "d as (select s1_id, target_id, try_cast(y as bigint) - try_cast(x as bigint) as d from y where length(x) = length(y)), m as (select s1_id, target_id, d, row_number() over (partition by s1_id, target_id order by abs(d), d) as rn from d where d is not null) "
    "select s1_id, target_id, d as delta from p left join (select * from m where rn = 1) using (s1_id, target_id)"
)
ORACLES["feat_38_sound_jaccard"] = f"{PQ}, q as (select s1_id, target_id, {s_sounds('na')} as a, {s_sounds('nb')} as b from p) select s1_id, target_id, round({JAC('a', 'b')}, 9) as sound_jaccard from q"
ORACLES["feat_39_format_noise"] = (
    f"{ALL}, f as (select entity_id, {', '.join(f'({f})::int as f{i}' for i, f in enumerate(FLAGS))} from (select entity_id, coalesce(business_name, '') as n, coalesce(business_address, '') as a from r)) "
    f"select entity_id, f0 as bit0, f2 as bit2, f12 as bit12, {' + '.join(f'f{i}' for i in range(len(FLAGS)))} as noise from f"
)

# Blocking ---------------------------------------------------------------------------
FIRST_SOUNDS = f"list_filter(list_slice({s_tokens(joined(s_phonetic('name')))}, 1, 2), lambda t: length(t) >= 3)"
ORACLES["join_18_phonetic_tokens"] = (
    f"{K}, i as (select * from (select *, row_number() over (partition by country, token order by target_id) as rn from (select distinct target_id, country, unnest({FIRST_SOUNDS}) as token from t)) where rn <= 20), "
    f"q as (select distinct s1_id, country, unnest({FIRST_SOUNDS}) as token from l) select distinct s1_id, target_id from q join i using (country, token)"
)


def key_sql(rel, id_name):
    """(id, family, key) as ``multi_keys`` makes them, the key as its parts and not as their hash."""
    base = f"(select {id_name} as id, country, {s_tokens('name')} as n, {s_tokens('addr')} as a from {rel})"
    base = f"(select *, list_slice(list_sort(n), 1, 4) as f, list_filter(a, lambda t: regexp_matches(t, '[0-9]')) as d from {base})"
    kinds = [
        ("name", "token", "unnest(n)", "''", base),
        ("name", "pre4", "unnest(list_transform(n, lambda t: left(t, 4)))", "''", base),
        ("name", "pair", "x", "y", f"(select *, unnest(list_filter(f, lambda t: t > x)) as y from (select *, unnest(f) as x from {base}))"),
        ("address", "token", "unnest(a)", "''", base),
        ("address", "number", "unnest(d)", "''", base),
        ("cross", "name+number", "x", "unnest(list_slice(d, 1, 3))", f"(select *, unnest(f) as x from {base})"),
    ]
    rows = " union all ".join(f"select id, country, '{family}' as family, '{kind}' as kind, {x} as x, {y} as y from {source}" for family, kind, x, y, source in kinds)
    return f"(select distinct id, family, concat_ws('|', kind, country, x, y) as key from ({rows}))"


KEYS = f"{K}, lk as {key_sql('l', 's1_id')}, rk as {key_sql('t', 'target_id')}"
PARTS = ", ".join(f"sum(case when lw.family = '{f}' then lw.w else 0 end) as bs_{f}" for f in ("name", "address", "cross"))
WEIGHED = (
    f"{KEYS}, n as (select count(distinct id) as n from rk), f as (select key, ln((n + 1)::double / (c + 1)) as w from (select key, count(*) as c from rk group by 1 having count(*) <= 60), n), "
    "lw as (select * from lk join f using (key)), rw as (select * from rk join f using (key)), lm as (select id, sum(w) as lm from lw group by 1), rm as (select id, sum(w) as rm from rw group by 1), "
    f"met as (select lw.id as s1_id, rw.id as target_id, sum(lw.w) as total, count(*) as n_keys, {PARTS} from lw join rw using (key) group by 1, 2), "
    "s as (select met.*, total / sqrt((lm + 1) * (rm + 1)) as score from met join lm on lm.id = s1_id join rm on rm.id = target_id)"
)
ORACLES["join_22_multi_keys"] = f"{KEYS} select family, count(*) as keys, count(distinct id) as records from lk group by 1"
ORACLES["join_23_key_weights"] = f"{KEYS} select family, postings, count(*) as keys from (select family, key, count(*) as postings from rk group by 1, 2) where postings <= 60 group by 1, 2"
ORACLES["join_24_weighted_key_join"] = f"{WEIGHED} select s1_id, target_id, rank, score, n_keys from (select s1_id, target_id, round(score, 9) as score, n_keys, row_number() over (partition by s1_id order by round(score, 9) desc, target_id) as rank from s) where rank <= 10"
ORACLES["join_25_normalised_score"] = f"{WEIGHED} select s1_id, target_id, round(score, 6) as score from s where score > 0.5"
place = lambda c: f"row_number() over (partition by s1_id order by round({c}, 9) desc, target_id)"
ORACLES["join_26_reserved_slots"] = f"{WEIGHED} select s1_id, target_id from (select s1_id, target_id, {place('score')} as r0, {', '.join(f'{place(f"bs_{f}")} as r_{f}' for f in ('name', 'address', 'cross'))} from s) where r0 <= 15 or r_name <= 4 or r_address <= 4 or r_cross <= 4"
ORACLES["stm_02_streamed_matching"] = f"{PAIR} l.name = t.name"
ORACLES["ml_12_training_pairs"] = EXTRA["join_27_hard_negatives"].replace("where rn <= 5", "where rn <= 3").replace("select s1_id, target_id from m", "select s1_id, target_id, 0 as label from m") + " union all select s1_id, target_id, 1 from truth"
CLEAN = s_once(f"[{s_replaced('n', (*Y.LONG_VOWELS, *Y.DIGRAPHS))}]", "not regexp_full_match(c, '[a-z]')") + "[1]"
ORACLES["ir_14_phonetic_channel"] = retrieval_sql(A.RECORDS, *[chosen(rel, gram_sql(CLEAN, 3, 4), "country = 'INDIA'") for rel in ("s1", "s2")], 10, 0.25, out="s1_id, target_id, score, rank")

# Learned components, features and decisions ----------------------------------------
LABELLED = f"{PQ}, q as (select p.*, (u.s1_id is not null)::int as label from p left join truth u on u.s1_id = p.s1_id and u.target_id = p.target_id)"
ORACLES["feat_18_phonetic_similarity"] = f"{PQ}, q as (select s1_id, target_id, {joined(s_phonetic('na'))} as sa, {joined(s_phonetic('nb'))} as sb from p) select s1_id, target_id, round(jaro_winkler_similarity(sa, sb), 9) as name_phonetic_sim from q"
ORACLES["lrn_02_back_off"] = f"with t as ({MATCH['lrn_01_token_log_odds']}), k as (select substr(token, 1, 3) as class, avg(log_odds) as by_class from t group by 1) select token, added, round(case when pos + neg >= 20 then log_odds else by_class end, 6) as log_odds from t join k on substr(token, 1, 3) = class"
ORACLES["lrn_04_delta_log_odds"] = (
    ORACLES["feat_35_closest_delta"].rsplit(" select s1_id, target_id, d as delta", 1)[0]
    + ", q as (select l.country as country_a, d as delta, (u.s1_id is not null)::int as label from m join l on l.s1_id = m.s1_id left join truth u on u.s1_id = m.s1_id and u.target_id = m.target_id where rn = 1), g as (select country_a, delta, sum(label) as pos, count(*) as n from q group by 1, 2) "
    "select country_a, delta, n, round(case when n >= 20 then pos::double / n else sum(pos) over (partition by delta)::double / sum(n) over (partition by delta) end, 6) as rate from g"
)
ORACLES["lrn_06_feature_separation"] = (
    f"{LABELLED}, g as (select s, sum(label) as p, count(*) - sum(label) as n from (select round(({JAC('tna', 'tnb')})::double, 9) as s, label from q) group by 1), "
    "h as (select *, sum(p) over (order by s) as cp, sum(n) over (order by s) as cn, sum(p) over () as tp, sum(n) over () as tn from g) "
    "select round((sum(p * (cn - n / 2.0)) / (any_value(tp) * any_value(tn)))::double, 9) as auc, round(max(abs(cp::double / tp - cn::double / tn)), 9) as ks from h"
)
ORACLES["eval_10_grid"] = (
    f"{C}, o as (select * from (select *, row_number() over (partition by target_id order by prob desc, s1_id) as o from c) where o = 1), x as (select *, {W} as r, max(prob) over (partition by s1_id) as top from o), "
    "y as (select *, top - coalesce(max(case when r = 2 then prob end) over (partition by s1_id), -1) as gap from x) "
    "select threshold, margin, count(*) as n, sum(label)::bigint as tp from y, (select unnest([0.4, 0.6, 0.8]::double[]) as threshold), (select unnest([0.0, 0.2]::double[]) as margin) where prob >= threshold and gap >= margin group by 1, 2"
)
ORACLES["dec_07_full_engine"] = (
    f"{CTX}, p as (select *, top - greatest(second, 0) as lead, max(case when rank = 1 then label end) over (partition by s1_id) = 1 as proof from y), "
    "t as (select *, case when top < 0.40 then 'C' when top >= 0.82 and (lead >= 0.12 or size = 1) then 'A' when top >= 0.68 then case when proof then 'A' when lead < 0.05 and top < 0.75 then 'C' else 'B' end else 'C' end as tier from p), "
    "v as (select *, prob >= case when starts_with(target_id, 'S3-') then 0.75 else 0.72 end as good from t where tier <> 'C'), "
    "w as (select *, max(good::int) over (partition by s1_id) as passed from v), "
    "e as (select s1_id, target_id, prob, least(prob, 1 - 1e-7) as q from w where good or (passed = 0 and tier = 'A' and rank = 1 and top >= 0.70)), "
    f"f as (select *, {W} as k, sum(q) over (partition by s1_id order by prob desc, target_id rows unbounded preceding) as tp, sum(q) over (partition by s1_id) as total, exp(sum(ln(1 - q)) over (partition by s1_id)) as nothing from e), "
    "g as (select *, round(1.25 * tp / (k + 0.25 * total), 12) as f from f), b as (select s1_id, arg_max(k, (f, -k)) as bk, max(f) as bf from g group by 1), "
    "h as (select g.*, row_number() over (partition by s1_id, substr(target_id, 1, 2) order by prob desc, target_id) as a from g join b using (s1_id) where k <= bk and bf >= nothing) select s1_id, target_id, prob from h where a <= 5"
)
