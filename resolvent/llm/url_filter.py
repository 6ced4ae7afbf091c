"""Operator 4: URL filter by explicit rules and a path-template tree.

Rules decide first, the longest that fits.  The pages they decide are labelled
data: per host, paths become templates (variable segments turn into wildcards,
statistically similar branches are merged), and a page without a rule is blocked
if its template's labelled pages are blocked with a high smoothed purity.

DataFrame operations only; the tree is built on counts of templates, one level
after the other, never on the pages of a host in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch

# The rules of the registered query, (host and path, verdict).
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)

#: Levels of the tree; what a path has below is one more segment.
DEPTH = 4
#: Children from which on a node's rare ones become a wildcard, and the share of the node's pages that makes a child rare.
KIDS, SHARE = 12, 0.05
#: Labelled pages that the prior counts as.
PRIOR = 5.0
#: Standard errors within which a branch is similar to its siblings together.
SIMILAR = 2.0
PURITY = 0.8
BROADCAST_ROWS = 20_000


def host_of(url: str) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.expr(f"regexp_extract(coalesce(`{url}`, ''), '^[\\\\s\\\\S]*?://([^/?#]*)', 1)")
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.expr(f"regexp_extract(coalesce(`{url}`, ''), '^[\\\\s\\\\S]*?://[^/?#]*([^?#]*)', 1)")


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; the earlier one of equal length."""
    ordered = sorted(rules, key=lambda r: -len(r[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in reversed(ordered):
        h, _, p = text.partition("/")
        p = "/" + p if "/" in text else ""
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    """A path's segments with numbers, hashes and the like as classes; DEPTH of them and the rest as one."""
    s = F.split(F.regexp_replace(path, "^/|/$", ""), "/")
    first = F.slice(s, 1, DEPTH)
    rest = F.when(F.size(s) > DEPTH, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    kind = lambda x: (
        F.when(x.rlike("^[0-9]+$"), F.lit("{n}"))
        .when(x.rlike("^[0-9]+\\.[A-Za-z]{2,5}$"), F.concat(F.lit("{n}"), F.regexp_extract(x, "\\.[A-Za-z]+$", 0)))
        .when(x.rlike("^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{h}"))
        .otherwise(x)
    )
    return F.concat(F.transform(first, kind), rest)


def template_tree(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """``counts`` (host, segs, n, blocked, allowed) with ``template``: the segments after wildcards.

    Level by level: at a node with more than KIDS children, children with less
    than SHARE of its pages become ``*``.
    """
    x = counts.withColumn("template", F.array().cast("array<string>"))
    for level in range(1, DEPTH + 2):
        x = x.withColumn("seg", F.try_element_at("segs", F.lit(level)))
        kids = x.where("seg is not null").groupBy("host", "template", "seg").agg(F.sum("n").alias("n"))
        nodes = kids.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("n").alias("total")).where(F.col("kids") > KIDS)
        rare = kids.join(nodes, ["host", "template"]).where(F.col("n") < SHARE * F.col("total")).select("host", "template", "seg", F.lit(True).alias("rare"))
        x = x.join(rare, ["host", "template", "seg"], "left")
        add = F.when(F.col("seg").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.when(F.col("rare"), "*").otherwise(F.col("seg"))))
        x = x.withColumn("template", F.concat("template", add)).drop("rare", "seg")
        x = scratch.cut(x, f"level{level}")
    return x


def template_verdicts(tree: DataFrame) -> DataFrame:
    """(host, segs, verdict) from the templates' labelled counts.

    Branches are siblings if they differ in their first segment only.  A branch
    with labels whose rate of blocked pages is within SIMILAR standard errors of
    its siblings' rate together is judged by the siblings' counts; others alone.
    """
    counts = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("l"))
    base = counts.agg((F.sum("b") / F.sum("l")).alias("base"))
    branch = F.concat(F.array(F.lit("*")), F.slice("template", 2, DEPTH + 1))
    counts = counts.withColumn("branch", branch)
    pooled = counts.where("l > 0").groupBy("host", "branch").agg(F.sum("b").alias("pb"), F.sum("l").alias("pl"), F.count("*").alias("members"))
    counts = counts.join(pooled, ["host", "branch"], "left")
    p = F.col("pb") / F.col("pl")
    alike = (F.col("l") > 0) & (F.col("members") > 1) & (F.abs(F.col("b") - F.col("l") * p) <= SIMILAR * F.sqrt(F.col("l") * p * (1 - p)) + 1e-9)
    counts = counts.withColumn("alike", F.coalesce(alike, F.lit(False)))
    # The similar members are added up again, without those that stand apart.
    merged = counts.where("alike").groupBy("host", "branch").agg(F.sum("b").alias("mb"), F.sum("l").alias("ml"))
    counts = counts.join(merged, ["host", "branch"], "left").join(F.broadcast(base))  # one row
    b, n = F.when(F.col("alike"), F.col("mb")).otherwise(F.col("b")), F.when(F.col("alike"), F.col("ml")).otherwise(F.col("l"))
    purity = (b + PRIOR * F.coalesce("base", F.lit(0.0))) / (n + PRIOR)
    counts = counts.select("host", "template", purity.alias("purity"), n.alias("labelled"))
    verdict = F.when((F.col("labelled") > 0) & (F.col("purity") >= PURITY), "block").otherwise("allow")
    return tree.select("host", "segs", "template").join(counts, ["host", "template"]).select("host", "segs", F.array_join("template", "/").alias("template"), "purity", verdict.alias("method"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict, template, purity) for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, no rule and
    no template, and is allowed.  Repeated rows count as often as they stand;
    other columns are not read; an empty table gives an empty table.
    """
    scratch = Scratch(pages.sparkSession)
    x = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    x = x.withColumn("rule", rule).withColumn("said", said).withColumn("segs", F.when(F.col("host") != "", _segments(F.col("path"))))
    counts = x.where("segs is not null").groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count_if(F.col("said") == "block").alias("blocked"), F.count_if(F.col("said") == "allow").alias("allowed")
    )
    judged = scratch.cut(template_verdicts(template_tree(scratch.cut(counts, "counts"), scratch)), "verdicts")
    if judged.count() <= BROADCAST_ROWS:
        judged = F.broadcast(judged)
    out = x.join(judged, ["host", "segs"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", "method", F.lit("allow")).alias("verdict"), "template", "purity")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _oracle(rules=RULES) -> str:
    """The result of op4 in DuckDB SQL, level by level."""
    ordered = sorted(rules, key=lambda r: -len(r[0]))
    fits = lambda t: f"(host = '{t.partition('/')[0]}' or host like '%.{t.partition('/')[0]}') and starts_with(path, '/{t.partition('/')[2]}')"
    rule = "case " + " ".join(f"when {fits(t)} then '{t}'" for t, _ in ordered) + " end"
    said = "case " + " ".join(f"when {fits(t)} then '{v}'" for t, v in ordered) + " end"
    kind = """case when regexp_full_match(x, '[0-9]+') then '{n}'
      when regexp_full_match(x, '[0-9]+\\.[A-Za-z]{2,5}') then '{n}' || regexp_extract(x, '\\.[A-Za-z]+$')
      when regexp_full_match(x, '[0-9a-fA-F-]{8,}') and regexp_matches(x, '[0-9]') then '{h}' else x end"""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = [
        f"""u as (select page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.)*?://([^/?#]*)', 1), '{upper}', '{lower}') as host,
             regexp_extract(coalesce(url, ''), '^(?s:.)*?://[^/?#]*([^?#]*)', 1) as path from pages)""",
        f"v as (select *, {rule} as rule, {said} as said, string_split(regexp_replace(path, '^/|/$', '', 'g'), '/') as s from u)",
        f"x as (select *, case when host <> '' then list_concat(list_transform(list_slice(s, 1, {DEPTH}), lambda x: {kind}), case when len(s) > {DEPTH} then ['**'] else []::varchar[] end) end as segs from v)",
        "t0 as (select host, segs, count(*) as n, count(case when said = 'block' then 1 end) as b, count(case when said = 'allow' then 1 end) as a, []::varchar[] as t from x where segs is not null group by host, segs)",
    ]
    for i in range(1, DEPTH + 2):
        q = f"t{i - 1}"
        out += [
            f"k{i} as (select host, t, segs[{i}] as seg, sum(n) as n from {q} where segs[{i}] is not null group by host, t, segs[{i}])",
            f"n{i} as (select host, t, count(*) as kids, sum(n) as total from k{i} group by host, t having count(*) > {KIDS})",
            f"r{i} as (select host, t, seg from k{i} join n{i} using (host, t) where k{i}.n < {SHARE} * total)",
            f"t{i} as (select q.host, segs, n, b, a, case when segs[{i}] is null then q.t when r.seg is not null then list_append(q.t, '*') else list_append(q.t, segs[{i}]) end as t from {q} q left join r{i} r on r.host = q.host and r.t = q.t and r.seg = q.segs[{i}])",
        ]
    last = f"t{DEPTH + 1}"
    out += [
        f"c as (select host, t, sum(b)::double as b, sum(a + b)::double as l, list_concat(['*'], list_slice(t, 2, {DEPTH + 2})) as br from {last} group by host, t)",
        "g as (select sum(b) / sum(l) as base from c)",
        "p as (select host, br, sum(b) / sum(l) as p, count(*) as members from c where l > 0 group by host, br)",
        f"d as (select c.*, coalesce(l > 0 and members > 1 and abs(b - l * p) <= {SIMILAR} * sqrt(l * p * (1 - p)) + 1e-9, false) as alike from c left join p using (host, br))",
        "m as (select host, br, sum(b) as mb, sum(l) as ml from d where alike group by host, br)",
        f"e as (select host, t, case when alike then ml else l end as l, ((case when alike then mb else b end) + {PRIOR} * coalesce(base, 0)) / ((case when alike then ml else l end) + {PRIOR}) as purity from d left join m using (host, br), g)",
        f"f as (select z.host, z.segs, case when e.l > 0 and e.purity >= {PURITY} then 'block' else 'allow' end as method from {last} z join e on e.host = z.host and e.t = z.t)",
    ]
    return "with " + ", ".join(out) + " select page_id, x.host, path, rule, coalesce(said, method, 'allow') as verdict from x left join f on f.host = x.host and f.segs = x.segs"


ORACLE = _oracle()
