"""Registered queries of scans and sinks (SRC, SNK) and of the streaming front end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io
from ..sources.schema import SOURCE
from ..streaming import stream
from . import adapters as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def tsv(s, d):
    path = io.work_path(s, "s1.tsv")
    io.write_tsv(A.s1(s, d), path)
    return path


def lists(s, d):
    pairs = A.truth(s, d)
    return io.id_lists(pairs.select("s1_id"), pairs)


LISTS = f"with {A.RECORDS}, x as (select s1_id as source1_entity_id, array_to_string(list_sort(list(distinct target_id)), ',') as matched_entity_ids from truth group by 1)"
ALL = f"with {A.RECORDS} select entity_id, business_name, business_address, country from s1"


def json_round_trip(s, d):
    path = io.work_path(s, "s1.json")
    io.write_json(A.s1(s, d), path)
    return s.read.schema(SOURCE).json(path)


def truth_round_trip(s, d):
    path = io.work_path(s, "truth.tsv")
    io.write_tsv(lists(s, d), path)
    return io.scan_truth(s, path)


def csv_report(s, d):
    path = io.work_path(s, "report.csv")
    io.write_report(A.s1(s, d).groupBy("country").agg(F.count("*").alias("n")), path)
    return s.read.schema("country string, n bigint").option("header", True).csv(path)


def parquet_round_trip(s, d):
    path = io.work_path(s, "by_country")
    A.s1(s, d).write.partitionBy("country").parquet(path)
    return s.read.parquet(path).where("country = 'France'").select("entity_id", "business_name")


def view_of(s, d):
    A.table(s, d, "customer").createOrReplaceTempView("resolvent_customer")
    return s.sql("select c_nationkey, count(*) as n from resolvent_customer group by c_nationkey")


add("src_01_tsv_scan", lambda s, d: io.scan_tsv(s, tsv(s, d)), ALL)
add("src_04_id_filter", lambda s, d: io.only_ids(A.targets(s, d), A.truth(s, d).select(F.col("target_id").alias("entity_id"))), f"with {A.RECORDS} select * from targets where entity_id in (select target_id from truth)")
add("src_05_checked_source", lambda s, d: io.scan_source(s, tsv(s, d)), ALL)
add("src_06_truth_pairs", truth_round_trip, f"with {A.RECORDS} select s1_id, target_id from truth")
add("src_07_parquet_columns", lambda s, d: A.table(s, d, "lineitem").select("l_orderkey", "l_quantity"), "select l_orderkey, l_quantity from lineitem")
add("src_08_json_scan", json_round_trip, ALL)
add("src_08b_json_fields", lambda s, d: A.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")), "select event_id, json_extract_string(props, '$.k') as k from events")
add("src_09_csv_report", csv_report, f"with {A.RECORDS} select country, count(*) as n from s1 group by 1")
add("src_11_registered_view", view_of, "select c_nationkey, count(*) as n from customer group by 1")
add("snk_01_id_lists", lists, f"{LISTS} select * from x")
add("snk_04_partitioned_parquet", parquet_round_trip, f"with {A.RECORDS} select entity_id, business_name from s1 where country = 'France'")
add("snk_06_union_lists", lambda s, d: io.union_lists(lists(s, d), lists(s, d)), f"{LISTS} select * from x")
add("stm_02_streamed_matching", stream.streamed_matches)
add("stm_01_windowed_counts", stream.windowed_counts, "select ts_hour, event_type, count(*) as n from (select date_trunc('hour', ts) as ts_hour, event_type from events) group by 1, 2")
