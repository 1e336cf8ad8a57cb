"""Wage filings: strings in with bound headers, one certified case a row out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.numbers import annual_wage, filing_date, fiscal_year
from gleaner.functions.text import employer_key, title_case, trimmed

#: The columns that a filing file must name.
HEADER = (
    "CASE_NUMBER CASE_STATUS DECISION_DATE VISA_CLASS JOB_TITLE SOC_CODE SOC_TITLE FULL_TIME_POSITION TOTAL_WORKER_POSITIONS NEW_EMPLOYMENT EMPLOYER_NAME "
    "WORKSITE_CITY WORKSITE_STATE WAGE_RATE_OF_PAY_FROM WAGE_RATE_OF_PAY_TO WAGE_UNIT_OF_PAY PW_WAGE_LEVEL"
).split()


def missing_columns(rows: DataFrame) -> list[str]:
    return [c for c in HEADER if c not in rows.columns]


def filing_cases(rows: DataFrame) -> DataFrame:
    """The readable certified cases of a file's rows, each case number once; other rows are left out.

    A header without one of the columns fails with the list of those that are missing.
    """
    if absent := missing_columns(rows):
        raise ValueError(f"missing columns: {', '.join(absent)}")
    text = {c: trimmed(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\0"), F.lit(""))) for c in HEADER}
    rows = rows.select(*[v.alias(c) for c, v in text.items()]).where("CASE_STATUS = 'Certified' AND VISA_CLASS = 'H-1B' AND CASE_NUMBER <> '' AND EMPLOYER_NAME <> '' AND JOB_TITLE <> ''")
    low, high = (annual_wage(F.col(f"WAGE_RATE_OF_PAY_{x}"), F.col("WAGE_UNIT_OF_PAY")) for x in ("FROM", "TO"))
    positive = lambda c: F.coalesce(F.col(c).try_cast("int") > 0, F.lit(False))
    cases = rows.select(
        F.col("CASE_NUMBER").alias("case_number"),
        filing_date(F.col("DECISION_DATE")).alias("decision_date"),
        F.col("EMPLOYER_NAME").alias("employer_name"),
        employer_key(F.col("EMPLOYER_NAME")).alias("employer_key"),
        F.col("JOB_TITLE").alias("job_title"),
        F.col("SOC_CODE").alias("soc_code"),
        F.col("SOC_TITLE").alias("soc_title"),
        low.alias("wage_from"),
        F.when(high >= F.coalesce(low, high), high).alias("wage_to"),
        F.col("PW_WAGE_LEVEL").alias("wage_level"),
        title_case(F.col("WORKSITE_CITY")).alias("worksite_city"),
        F.upper("WORKSITE_STATE").alias("worksite_state"),
        F.when(positive("TOTAL_WORKER_POSITIONS"), F.col("TOTAL_WORKER_POSITIONS").try_cast("int")).otherwise(1).alias("positions"),
        positive("NEW_EMPLOYMENT").alias("new_employment"),
        (F.col("FULL_TIME_POSITION") != "N").alias("full_time"),
    )
    cases = cases.where("decision_date IS NOT NULL AND employer_key <> ''").withColumn("fiscal_year", fiscal_year(F.col("decision_date")))
    newest = cases.groupBy("case_number").agg(F.max(F.struct("decision_date", *[c for c in cases.columns if c not in ("case_number", "decision_date")])).alias("c"))
    return newest.select("case_number", "c.*")
