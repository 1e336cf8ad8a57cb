"""Scores, wages, dates and spans of time as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.joins import met


def rubric_score(role, seniority, skills, domain, location, blocker, coverage):
    """Fit from 0 to 100 of ratings from 0 to 10; coverage is the measured share of required skills, null when unknown."""
    shown = F.when(coverage.isNotNull(), 0.6 * skills + 4.0 * coverage).otherwise(skills)
    score = 10 * (0.35 * role + 0.25 * shown + 0.20 * seniority + 0.10 * domain + 0.10 * location)
    score = score * (0.6 + 0.4 * F.least(role, F.lit(5)) / 5) * (0.7 + 0.3 * F.least(seniority, F.lit(4)) / 4)
    score = F.when(blocker, score * 0.4).otherwise(score)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("int")


def ratings_valid(*ratings):
    return reduce(lambda a, b: a & b, [F.coalesce(r.between(0, 10), F.lit(False)) for r in ratings])


def verdict(score):
    return F.when(score >= 80, "strong").when(score >= 65, "good").when(score >= 45, "stretch").otherwise("poor")


def coverage(matched, missing):
    """Share of listed skills that are matched; null for fewer than three."""
    n = F.size(matched) + F.size(missing)
    return F.when(n >= 3, F.size(matched) / n)


#: The order of levels.
LEVELS = {"internship": 0, "entry": 1, "junior": 2, "mid": 3, "senior": 4, "management": 5}


def level_gap(level, accepted: list[str]):
    """Levels between a posting's and the nearest accepted one; one where either is unknown."""
    own = reduce(lambda c, x: c.when(level == x[0], x[1]), list(LEVELS.items())[1:], F.when(level == "internship", 0))
    known = [LEVELS[x] for x in accepted if x in LEVELS]
    if not known:
        return F.lit(1)
    return F.coalesce(F.array_min(F.transform(F.array(*map(F.lit, known)), lambda k: F.abs(k - own))), F.lit(1))


def near_limit(years, most: int):
    """How far a demand for years reaches into the last three that are accepted; 0 where either is unknown."""
    return F.coalesce(F.greatest(F.lit(0), years - most + 3), F.lit(0)) if most > 0 else F.lit(0)


def learned_weight(n):
    return 2 * n / (n + 200)


#: Pay periods a year.
PERIODS = {"year": 1, "month": 12, "bi-weekly": 26, "week": 52, "hour": 2080}


def annual_wage(text, unit):
    """Yearly wage of a figure like $150,000.00 and its period, to whole units; null if unreadable or implausible."""
    value = F.regexp_replace(text, "[$, ]", "").try_cast("double")
    kind = F.lower(F.trim(unit))
    times = reduce(lambda c, x: c.when(kind == x[0], x[1]), list(PERIODS.items())[1:], F.when(kind == "year", 1))
    yearly = value * times
    return F.when((value > 0) & yearly.between(15000, 2000000), F.floor(yearly + 0.5).cast("double"))


def filing_date(text):
    """Date of a filing in one of five layouts or as a spreadsheet serial number; null if none fits."""
    layouts = {r"^\d\d-\d\d-\d\d$": "MM-dd-yy", r"^\d{4}-\d\d-\d\d$": "yyyy-MM-dd", r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/yyyy", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$": "yyyy-MM-dd HH:mm:ss"}
    dates = [F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(layout)))) for shape, layout in layouts.items()]
    number = text.try_cast("double")
    serial = F.when((number > 30000) & (number < 80000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int")))
    return F.coalesce(*dates, serial)


def fiscal_year(date):
    """The federal fiscal year, which begins in October."""
    return F.year(date) + (F.month(date) >= 10).cast("int")


def in_maintenance(ts, zone: str = "America/Los_Angeles"):
    """Whether an instant is between Friday 23:00 and Saturday 03:00 local time."""
    local = F.from_utc_timestamp(ts, zone)
    return ((F.dayofweek(local) == 6) & (F.hour(local) >= 23)) | ((F.dayofweek(local) == 7) & (F.hour(local) < 3))


def months_covered(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows (*keys, months): how many units the half-open spans [start, end) of each key cover, overlaps once."""
    spans = rows.where(F.col(end) > F.col(start))
    order = Window.partitionBy(*keys).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(start) > reached).cast("int"), F.lit(1))
    islands = spans.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order))
    lengths = islands.groupBy(*keys, "_island").agg((F.max(end) - F.min(start)).alias("_length"))
    return lengths.groupBy(*keys).agg(F.sum("_length").alias("months"))


def z_scores(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with z_<column>: the value in standard deviations from the key's mean over the rows that have one; 0 without spread or value."""
    stats = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in columns])
    joined = met(rows, stats, *keys)
    z = {f"z_{c}": F.coalesce(F.when(F.col(f"_sd_{c}") > 0, (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}")), F.lit(0.0)) for c in columns}
    return joined.withColumns(z).drop(*[f"_{x}_{c}" for c in columns for x in ("mean", "sd")])


def scaled(rows: DataFrame, keys: list[str], column: str, name: str = "estimate") -> DataFrame:
    """``rows`` with the column drawn linearly to 35..85 within each key; 85 where all are equal."""
    ends = rows.groupBy(*keys).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    share = F.when(F.col("_high") > F.col("_low"), (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(1.0)
    return met(rows, ends, *keys).withColumn(name, 35 + 50 * share).drop("_low", "_high")


def whole_ranks(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``rows`` with the column drawn to whole numbers from 35 to 85 within each key; 50 where it is null."""
    return scaled(rows, keys, column, name).withColumn(name, F.when(F.col(column).isNull(), 50).otherwise(F.round(name)).cast("int"))
