"""Business records made from the driver's tables.

The expressions are read alike by Spark and DuckDB, so a query and its oracle
start from the same rows.  S1, S2 and S3 each cover the whole table ``part``;
records of one part are true matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LONG = "case p_partkey % 6 when 0 then 'Private Limited' when 1 then 'Incorporated' when 2 then 'LLC' when 3 then 'Corporation' when 4 then 'Company' else 'Limited' end"
_SHORT = "case p_partkey % 6 when 0 then 'Pvt Ltd' when 1 then 'Inc' when 2 then 'LLC' when 3 then 'Corp' when 4 then 'Co' else 'Ltd' end"
_POSTAL = "case p_size % 3 when 1 then 110000 + p_partkey % 880000 else 10000 + p_partkey % 80000 end"
_COUNTRY = "case p_size % 3 when 0 then 'US' when 1 then 'India' else 'France' end"
_STREET = "concat(p_partkey % 997, ' ', p_brand)"

S1 = {
    "entity_id": "concat('S1-', p_partkey)",
    "business_name": f"concat(case p_partkey % 7 when 0 then 'Café ' when 1 then 'Shree ' when 2 then 'A&B ' else '' end, p_name, ' ', {_LONG})",
    "business_address": f"concat({_STREET}, ' Street, Apt ', p_size, ', ', {_POSTAL})",
    "country": _COUNTRY,
}
S2 = {
    "entity_id": "concat('S2-', p_partkey)",
    "business_name": f"concat(case p_partkey % 7 when 0 then 'CAFE ' when 1 then 'Sri ' when 2 then 'A and B ' else '' end, upper(p_name), ' ', {_SHORT})",
    "business_address": f"case p_partkey % 5 when 0 then '' else concat({_STREET}, ' St., ', {_POSTAL}) end",
    "country": f"case p_partkey % 11 when 0 then upper({_COUNTRY}) else {_COUNTRY} end",
}
S3 = {
    "entity_id": "concat('S3-', p_partkey)",
    "business_name": f"case p_partkey % 4 when 0 then concat('www.', replace(p_name, ' ', '-'), '.com') when 1 then concat(p_name, ' dba ', p_brand, ' trade') else concat(p_name, ' ', {_SHORT}) end",
    "business_address": f"case p_partkey % 3 when 0 then null else concat('# ', {_STREET}, ' Rd, ', {_POSTAL}) end",
    "country": _COUNTRY,
}


def relation(spec: dict[str, str]) -> str:
    """A SELECT over ``part`` that both engines read."""
    return "select " + ", ".join(f"{e} as {n}" for n, e in spec.items()) + " from part"


#: CTEs for oracles.
RECORDS = f"s1 as ({relation(S1)}), s2 as ({relation(S2)}), s3 as ({relation(S3)}), targets as (select * from s2 union all select * from s3), truth as (select concat('S1-', p_partkey) as s1_id, concat('S2-', p_partkey) as target_id from part union all select concat('S1-', p_partkey), concat('S3-', p_partkey) from part)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, spec: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} as {n}" for n, e in spec.items()])


def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, S1)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, S2).unionByName(records(spark, sf_dir, S3))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pair = lambda s: p.selectExpr("concat('S1-', p_partkey) as s1_id", f"concat('{s}-', p_partkey) as target_id")
    return pair("S2").unionByName(pair("S3"))
