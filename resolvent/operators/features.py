"""Named pair features (FEAT) over candidate rows that carry both records' views.

Input columns come in pairs with the suffixes ``_a`` (reference) and ``_b``
(target): name, addr (normalised), postal, house, compact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X


def _present(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit(""))) > 0


def _num(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def pair_features() -> dict[str, Column]:
    """All native features by name, in a fixed order."""
    na, nb, aa, ab = F.col("name_a"), F.col("name_b"), F.col("addr_a"), F.col("addr_b")
    tna, tnb, taa, tab = (X.tokens(F.coalesce(c, F.lit(""))) for c in (na, nb, aa, ab))
    has_a, has_b = _present(aa), _present(ab)
    both = has_a & has_b
    name_lev, addr_lev = S.levenshtein_ratio(na, nb), S.levenshtein_ratio(aa, ab)
    name_jac, addr_jac = S.jaccard(tna, tnb), S.jaccard(taa, tab)
    exact_n, exact_a = (na == nb) & _present(na), (aa == ab) & has_a
    postal = (F.col("postal_a") == F.col("postal_b")) & _present(F.col("postal_a"))
    house = (F.col("house_a") == F.col("house_b")) & _present(F.col("house_a"))
    last3 = lambda t: F.when(F.size(t) >= 3, F.slice(t, -3, 3)).otherwise(t)
    digits = lambda t: F.filter(t, lambda x: x.rlike("[0-9]"))
    g = lambda c: X.char_grams(F.coalesce(c, F.lit("")), 3)
    ta1, tb1 = F.try_element_at(tna, F.lit(1)), F.try_element_at(tnb, F.lit(1))
    houses = _present(F.col("house_a")) & _present(F.col("house_b")) & (F.col("house_a") != F.col("house_b"))
    return {
        "name_exact": _num(exact_n), "addr_exact": _num(exact_a),
        "name_levenshtein": name_lev, "addr_levenshtein": addr_lev,
        "name_jaccard": name_jac, "addr_jaccard": addr_jac,
        "name_token_overlap": S.overlap(tna, tnb), "addr_token_overlap": S.overlap(taa, tab),
        "name_length_ratio": F.when(_present(na) & _present(nb), F.least(F.length(na), F.length(nb)) / F.greatest(F.length(na), F.length(nb))).otherwise(0.0),
        "has_addr_s1": _num(has_a), "has_addr_tgt": _num(has_b), "both_addr_present": _num(both), "addr_missing": _num(~both),
        "postal_match": _num(postal), "house_num_match": _num(house),
        "postal_any": _num(F.arrays_overlap(F.filter(taa, lambda x: x.rlike("^[0-9]{5,6}$")), F.filter(tab, lambda x: x.rlike("^[0-9]{5,6}$")))),
        "name_addr_agree": _num(exact_n & exact_a), "name_postal_agree": _num(exact_n & postal),
        "name_x_addr_present": name_jac * _num(both), "name_x_addr_missing": name_jac * _num(~both),
        "addr_nan": F.when(both, addr_lev).otherwise(F.lit(float("nan"))),
        "either_addr_missing": _num(~both), "name_strong_addr_missing": _num((name_lev >= 0.88) & ~both),
        "name_containment": _num(_present(na) & _present(nb) & (na.contains(nb) | nb.contains(na))),
        "name_token_diff": F.abs(F.size(tna) - F.size(tnb)).cast("double"),
        "name_char3_jaccard": S.jaccard(g(na), g(nb)), "addr_char3_jaccard": S.jaccard(g(aa), g(ab)),
        "name_char3_cos": S.set_cosine(g(na), g(nb)), "addr_char3_cos": S.set_cosine(g(aa), g(ab)),
        "city_overlap": S.jaccard(last3(taa), last3(tab)), "numeric_overlap": S.jaccard(digits(taa), digits(tab)),
        "target_source_s3": _num(F.col("target_id").startswith("S3-")),
        "first_token_match": _num(ta1 == tb1), "first_token_conflict": _num(ta1 != tb1),
        "primary_num_mismatch": _num(houses), "name_high_but_num_conflict": _num((name_lev > 0.85) & houses),
        "cross_prod": name_lev * addr_lev,
        "country_eq": _num(F.upper(F.col("country_a")) == F.upper(F.col("country_b"))),
        "added_tokens": F.size(F.array_except(tnb, tna)).cast("double"), "dropped_tokens": F.size(F.array_except(tna, tnb)).cast("double"),
        "number_near": _num(F.exists(digits(taa), lambda x: F.exists(digits(tab), lambda y: F.levenshtein(x, y) <= 1))),
    }


def with_features(pairs: DataFrame, names: list[str] | None = None) -> DataFrame:
    all_ = pair_features()
    return pairs.withColumns({n: all_[n] for n in (names or list(all_))})


def joined_views(candidates: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates (s1_id, target_id, ...) with both records' views; two equi joins on ids."""
    cols = {"name": "norm_name", "addr": "norm_addr", "postal": "postal_code", "house": "house_number", "country": "country"}
    a = left.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"{n}_a") for n, c in cols.items()])
    b = right.select(F.col("entity_id").alias("target_id"), *[F.col(c).alias(f"{n}_b") for n, c in cols.items()])
    return candidates.join(a, "s1_id").join(b, "target_id")


def token_log_odds(pairs: DataFrame, least: int = 25, prior: float = 1.0) -> DataFrame:
    """(token, added, pos, neg, log_odds): how much an added or dropped word speaks for a match (LRN-01).

    ``pairs`` has the word arrays ta, tb and a 0/1 label.
    """
    change = lambda a, b, added: pairs.select(F.lit(added).alias("added"), "label", F.explode(F.array_except(a, b)).alias("token"))
    x = change("tb", "ta", 1).unionByName(change("ta", "tb", 0)).groupBy("token", "added").agg(F.sum("label").alias("pos"), (F.count("*") - F.sum("label")).alias("neg"))
    n = pairs.agg(F.sum("label").alias("np"), (F.count("*") - F.sum("label")).alias("nn"))
    x = x.where(F.col("pos") + F.col("neg") >= least).join(F.broadcast(n))  # one row
    odds = F.log((F.col("pos") + prior) / (F.col("np") + prior)) - F.log((F.col("neg") + prior) / (F.col("nn") + prior))
    return x.select("token", "added", "pos", "neg", F.round(odds, 9).alias("log_odds"))
