"""The study's tables as views of the star schema at hand; each mapping is one SQL text that other engines can run as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RESPONSES = """
select concat_ws('-', cast(l_orderkey as varchar(20)), cast(l_linenumber as varchar(20)), cast(l_partkey as varchar(20)), cast(l_suppkey as varchar(20))) as response_id,
       concat('v3_', case l_linestatus when 'F' then 'a1_' else 'b1_' end, case l_returnflag when 'A' then 'alpha' when 'N' then 'beta' else 'gamma' end) as experiment_tag,
       cast(floor(l_orderkey / 8.0) as bigint) as sample_ordinal,
       case l_returnflag when 'A' then 4 when 'N' then 5 else 7 end as scale_size,
       cast((l_partkey*31 + l_suppkey*17 + l_linenumber*7) % (case l_returnflag when 'A' then 16 when 'N' then 32 else 128 end) as bigint) as mask,
       cast(l_partkey % 20 as bigint) as bundle_no,
       1 - l_discount*2 as agreement, 1 - l_tax as obs, 1 - l_tax/2 as disc
from {lineitem}"""

#: Requests: one attempt a row, keyed by user; purchases succeed, errors fail, views are pending.
REQUESTS = """
select concat('run:', cast(user_id as varchar(20)), ':', case when user_id % 2 = 0 then 'score_gen' else 'rubric_gen' end) as custom_key, event_id as request_id, ts,
       case event_type when 'purchase' then 'success' when 'error' then 'error' when 'view' then 'pending' else 'ignored' end as status,
       case event_id % 9 when 0 then 'Rate limit (429)' when 1 then 'Failed to parse verdict line' when 2 then 'Request timeout' when 3 then 'insufficient_quota'
            when 4 then 'The request timed out; try again later' when 5 then 'too many bytes read' when 6 then 'provider refused' when 7 then '' else 'Temporarily unavailable' end as error,
       case when event_id % 5 = 0 then null else event_id % 4 + 1 end as attempt_index
from {events}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESPONSES.format(lineitem="{lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTS.format(events="{events}"), events=table(spark, sf_dir, "events"))
