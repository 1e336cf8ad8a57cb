"""The engine's domain tables as projections of the test tables.

``Tables`` gives each as a DataFrame; ``WITH_TABLES`` says the same in ANSI SQL for the queries' checks. Every
projection is deterministic and reads only the columns that it needs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of queries over postings and over events; never the clock.
POSTING_NOW, EVENT_NOW = "2001-08-01 00:00:00", "2024-01-30 12:00:00"
USERS = 7


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def companies(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("industry"),
            (F.col("c_acctbal") >= 0).alias("enabled"),
            F.when(key % 17 == 0, "manual").otherwise(F.concat(F.lit("board"), (F.col("c_nationkey") % 10).cast("string"))).alias("ats"),
            F.col("c_nationkey").alias("nation_id"),
            F.when(key % 5 == 0, None).otherwise(key % 3 == 0).alias("last_fetch_ok"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        key, seen = F.col("o_orderkey"), F.col("o_orderdate")
        last = seen + F.make_dt_interval((key % 40).cast("int"))
        return self.raw("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("company_id"),
            F.when(key % 17 == 0, "manual").otherwise(F.concat(F.lit("board"), (key % 10).cast("string"))).alias("source"),
            F.concat(F.lit("x"), key.cast("string")).alias("ext_id"),
            F.col("o_orderpriority").alias("title"),
            F.concat(F.lit("https://jobs.example/"), (key % 1000).cast("string"), F.lit("/")).alias("url"),
            seen.alias("first_seen_at"),
            last.alias("last_seen_at"),
            F.when(F.col("o_orderstatus") == "F", last).alias("closed_at"),
            (key % 97).alias("content_hash"),
        )

    @cached_property
    def user_jobs(self) -> DataFrame:
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        return self.raw("orders").select(
            (key % USERS).alias("user_id"),
            key.alias("job_id"),
            F.when(status == "F", "excluded").when(status == "P", "pending_score").otherwise("scored").alias("stage"),
            F.when(status == "F", F.element_at(F.array(*map(F.lit, ("title:senior", "title:no_category", "location:non_us", "sponsorship:explicit_no"))), (key % 4 + 1).cast("int"))).alias("exclude_reason"),
            F.array(F.lower(F.substring_index("o_orderpriority", "-", 1)), F.lower(status)).alias("categories"),
            (35 + key % 51).alias("estimate"),
            F.when(key % 11 == 0, (key + 1) % 97).otherwise(key % 97).alias("content_hash"),
        )

    @cached_property
    def analyses(self) -> DataFrame:
        job, line, quantity = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("long")
        kind = F.when(F.col("l_returnflag") == "R", "deep").otherwise("score")
        return self.raw("lineitem").select(
            (job * 10 + line).alias("id"),
            job.alias("job_id"),
            (job % USERS).alias("user_id"),
            kind.alias("kind"),
            (job % 97 + line % 2).alias("profile_hash"),
            F.least(quantity * 2, F.lit(100)).alias("score"),
            F.when(line % 4 == 0, None).when(F.col("l_linestatus") == "O", "yes").when(line % 3 == 0, "no").otherwise("unclear").alias("sponsorship"),
            F.when(line % 3 == 0, F.concat(F.lit("quote "), F.col("l_suppkey").cast("string"))).alias("quote"),
            (quantity * 100).alias("prompt_tokens"),
            (quantity * (line % 3) * 30).alias("cached_tokens"),
            (quantity * 10).alias("completion_tokens"),
            F.round(F.col("l_tax") * 100).cast("long").alias("cost_cents"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def applications(self) -> DataFrame:
        key = F.col("o_orderkey")
        status = F.element_at(F.array(*map(F.lit, ("saved", "applied", "interviewing", "rejected"))), (key % 4 + 1).cast("int"))
        return self.raw("orders").where(key % 6 == 0).select((key % USERS).alias("user_id"), key.alias("job_id"), status.alias("status"))

    @cached_property
    def filings(self) -> DataFrame:
        line = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag")
        part = self.raw("part").select("p_partkey", "p_name", "p_size", "p_brand")
        employer = self.raw("supplier").select("s_suppkey", "s_name", "s_nationkey").join(self.raw("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        date = F.col("l_shipdate")
        rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(employer, F.col("l_suppkey") == F.col("s_suppkey"))
        return rows.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"),
            F.col("l_suppkey").alias("employer_id"),
            F.lower("s_name").alias("employer_key"),
            F.col("s_name").alias("employer_name"),
            F.col("p_name").alias("job_title"),
            F.col("p_brand").alias("soc_code"),
            F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV"))), (F.col("p_size") % 4 + 1).cast("int")).alias("wage_level"),
            F.when(F.col("l_discount") != 0.04, F.col("l_extendedprice")).alias("wage_from"),
            F.col("n_name").alias("place"),
            (F.col("l_returnflag") == "N").alias("new_employment"),
            (F.year(date) + (F.month(date) >= 10).cast("int")).alias("fiscal_year"),
            date.alias("decision_date"),
        )

    @cached_property
    def usage(self) -> DataFrame:
        return self.raw("events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("cost_cents"), F.col("ts").alias("created_at"))

    @cached_property
    def attempts(self) -> DataFrame:
        question = F.get_json_object("props", "$.k").cast("long")
        return self.raw("events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("domain"), question.alias("question_id"), (F.col("event_id") % 3 > 0).alias("correct"), F.col("ts").alias("created_at"))

    @cached_property
    def posts(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("id"),
            (F.col("doc_id") % 50).alias("author_id"),
            F.array("lang", "source").alias("tags"),
            F.col("text").alias("body"),
            F.when(F.col("doc_id") % 13 == 0, "hidden").otherwise("visible").alias("status"),
        )


WITH_TABLES = """
WITH companies AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS industry, c_acctbal >= 0 AS enabled,
    CASE WHEN c_custkey % 17 = 0 THEN 'manual' ELSE 'board' || CAST(c_nationkey % 10 AS VARCHAR) END AS ats, c_nationkey AS nation_id,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 3 = 0 END AS last_fetch_ok
  FROM customer
), jobs AS (
  SELECT o_orderkey AS id, o_custkey AS company_id,
    CASE WHEN o_orderkey % 17 = 0 THEN 'manual' ELSE 'board' || CAST(o_orderkey % 10 AS VARCHAR) END AS source,
    'x' || CAST(o_orderkey AS VARCHAR) AS ext_id, o_orderpriority AS title,
    'https://jobs.example/' || CAST(o_orderkey % 1000 AS VARCHAR) || '/' AS url, o_orderdate AS first_seen_at,
    o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) AS last_seen_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) END AS closed_at, o_orderkey % 97 AS content_hash
  FROM orders
), user_jobs AS (
  SELECT o_orderkey % 7 AS user_id, o_orderkey AS job_id,
    CASE o_orderstatus WHEN 'F' THEN 'excluded' WHEN 'P' THEN 'pending_score' ELSE 'scored' END AS stage,
    CASE WHEN o_orderstatus = 'F' THEN ['title:senior', 'title:no_category', 'location:non_us', 'sponsorship:explicit_no'][o_orderkey % 4 + 1] END AS exclude_reason,
    [lower(split_part(o_orderpriority, '-', 1)), lower(o_orderstatus)] AS categories, 35 + o_orderkey % 51 AS estimate,
    CASE WHEN o_orderkey % 11 = 0 THEN (o_orderkey + 1) % 97 ELSE o_orderkey % 97 END AS content_hash
  FROM orders
), analyses AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS job_id, l_orderkey % 7 AS user_id,
    CASE WHEN l_returnflag = 'R' THEN 'deep' ELSE 'score' END AS kind, l_orderkey % 97 + l_linenumber % 2 AS profile_hash,
    least(CAST(l_quantity AS BIGINT) * 2, 100) AS score,
    CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'yes' WHEN l_linenumber % 3 = 0 THEN 'no' ELSE 'unclear' END AS sponsorship,
    CASE WHEN l_linenumber % 3 = 0 THEN 'quote ' || CAST(l_suppkey AS VARCHAR) END AS quote,
    CAST(l_quantity AS BIGINT) * 100 AS prompt_tokens, CAST(l_quantity AS BIGINT) * (l_linenumber % 3) * 30 AS cached_tokens,
    CAST(l_quantity AS BIGINT) * 10 AS completion_tokens, CAST(round(l_tax * 100) AS BIGINT) AS cost_cents, l_shipdate AS created_at
  FROM lineitem
), applications AS (
  SELECT o_orderkey % 7 AS user_id, o_orderkey AS job_id, ['saved', 'applied', 'interviewing', 'rejected'][o_orderkey % 4 + 1] AS status
  FROM orders WHERE o_orderkey % 6 = 0
), filings AS (
  SELECT l_orderkey * 10 + l_linenumber AS case_id, l_suppkey AS employer_id, lower(s_name) AS employer_key, s_name AS employer_name,
    p_name AS job_title, p_brand AS soc_code, ['I', 'II', 'III', 'IV'][p_size % 4 + 1] AS wage_level,
    CASE WHEN l_discount <> 0.04 THEN l_extendedprice END AS wage_from, n_name AS place, l_returnflag = 'N' AS new_employment,
    CAST(year(l_shipdate) + CAST(month(l_shipdate) >= 10 AS INTEGER) AS INTEGER) AS fiscal_year, l_shipdate AS decision_date
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), usage AS (
  SELECT event_id AS id, user_id, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS cost_cents, ts AS created_at FROM events
), attempts AS (
  SELECT event_id AS id, user_id, event_type AS domain, CAST(json_extract_string(props, '$.k') AS BIGINT) AS question_id, event_id % 3 > 0 AS correct, ts AS created_at FROM events
), posts AS (
  SELECT doc_id AS id, doc_id % 50 AS author_id, [lang, source] AS tags, text AS body, CASE WHEN doc_id % 13 = 0 THEN 'hidden' ELSE 'visible' END AS status FROM documents
)"""
