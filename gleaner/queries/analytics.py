"""Aggregations: usage, spend, stages, companies, industries, wage filings and sponsorship."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.latest import first_per_key, nearest_ranks
from gleaner.plans.tables import EVENT_NOW, POSTING_NOW, Tables
from gleaner.queries.register import registry

QUERIES, ORACLES, query = registry()


def day(ts):
    return F.date_format(ts, "yyyy-MM-dd")


def stamp(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


@query("""
SELECT c.id, c.name, count(j.id) AS jobs, count(j.id) FILTER (j.closed_at IS NULL) AS open_jobs,
  strftime(max(j.first_seen_at) FILTER (j.closed_at IS NULL), '%Y-%m-%d') AS newest
FROM companies c LEFT JOIN jobs j ON j.company_id = c.id WHERE c.ats <> 'manual' GROUP BY c.id, c.name""")
def company_stats(t: Tables) -> DataFrame:
    jobs = t.jobs.groupBy("company_id").agg(F.count("*").alias("jobs"), F.count(F.when(F.col("closed_at").isNull(), 1)).alias("open_jobs"), day(F.max(F.when(F.col("closed_at").isNull(), F.col("first_seen_at")))).alias("newest"))
    rows = t.companies.where("ats <> 'manual'").join(jobs, F.col("id") == F.col("company_id"), "left")
    return rows.select("id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("jobs", "open_jobs")], "newest")


@query("""
SELECT c.industry, count(DISTINCT c.id) FILTER (c.enabled) AS companies, count(j.id) FILTER (j.closed_at IS NULL) AS open_jobs,
  count(u.job_id) FILTER (u.stage = 'scored') AS scored, max(u.estimate) FILTER (u.stage = 'scored') AS top_score
FROM companies c LEFT JOIN jobs j ON j.company_id = c.id LEFT JOIN user_jobs u ON u.job_id = j.id AND u.user_id = 3 GROUP BY c.industry""")
def industry_counts(t: Tables) -> DataFrame:
    # counts over the joined rows are summed per company first: the distinct count of companies needs no fan-out then
    jobs = t.jobs.select("id", "company_id", "closed_at").join(t.user_jobs.where("user_id = 3").select("job_id", "stage", "estimate"), F.col("id") == F.col("job_id"), "left")
    scored = F.when(F.col("stage") == "scored", F.col("estimate"))
    per_company = jobs.groupBy("company_id").agg(F.count(F.when(F.col("closed_at").isNull(), 1)).alias("open_jobs"), F.count(scored).alias("scored"), F.max(scored).alias("top_score"))
    rows = t.companies.select("id", "industry", "enabled").join(per_company, F.col("id") == F.col("company_id"), "left")
    return rows.groupBy("industry").agg(
        F.count(F.when(F.col("enabled"), 1)).alias("companies"),
        F.coalesce(F.sum("open_jobs"), F.lit(0)).alias("open_jobs"),
        F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"),
        F.max("top_score").alias("top_score"),
    )


@query("""
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(cost_cents) AS BIGINT) AS cost_cents
FROM analyses GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def usage_per_day(t: Tables) -> DataFrame:
    """The last 30 days that have rows, not the last 30 days."""
    days = t.analyses.groupBy(day("created_at").alias("day"))
    return days.agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("cost_cents").alias("cost_cents")).orderBy(F.desc("day")).limit(30)


@query("""
SELECT count(*) AS calls, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(cached_tokens), 0) AS BIGINT) AS cached_tokens,
  CAST(sum(cached_tokens) AS DOUBLE) * 100 / nullif(CAST(sum(prompt_tokens) AS DOUBLE), 0) AS cached_percent FROM analyses""")
def usage_totals(t: Tables) -> DataFrame:
    sums = t.analyses.agg(F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("cached_tokens"), F.lit(0)).alias("cached_tokens"))
    return sums.withColumn("cached_percent", F.try_divide(F.col("cached_tokens").cast("double") * 100, F.col("prompt_tokens").cast("double")))


MONTH_SQL = f"""
, spent AS (
  SELECT user_id, cost_cents FROM usage WHERE date_trunc('month', created_at) = date_trunc('month', TIMESTAMP '{EVENT_NOW}')
  UNION ALL SELECT user_id, cost_cents FROM analyses WHERE date_trunc('month', created_at) = date_trunc('month', TIMESTAMP '2001-07-15')
)"""


def month_rows(t: Tables) -> DataFrame:
    """Model spend of the month from its two sources: calls of their own and analyses."""
    same = lambda ts, now: F.date_trunc("month", ts) == F.date_trunc("month", F.to_timestamp(F.lit(now)))
    calls = t.usage.where(same("created_at", EVENT_NOW)).select("user_id", "cost_cents")
    return calls.unionByName(t.analyses.where(same("created_at", "2001-07-15 00:00:00")).select("user_id", "cost_cents"))


@query(MONTH_SQL + "SELECT CAST(coalesce(sum(cost_cents), 0) AS BIGINT) AS cost_cents FROM spent")
def month_spend(t: Tables) -> DataFrame:
    return month_rows(t).agg(F.coalesce(F.sum("cost_cents"), F.lit(0)).alias("cost_cents"))


@query(MONTH_SQL + """
SELECT user_id, CAST(sum(cost_cents) AS BIGINT) AS cost_cents, greatest(0, 50000 - CAST(sum(cost_cents) AS BIGINT)) AS left_cents FROM spent GROUP BY user_id""")
def spend_by_user(t: Tables) -> DataFrame:
    return month_rows(t).groupBy("user_id").agg(F.sum("cost_cents").alias("cost_cents")).withColumn("left_cents", F.greatest(F.lit(0), 50000 - F.col("cost_cents")))


@query("SELECT user_id, stage, count(*) AS n FROM user_jobs GROUP BY ALL")
def stage_histogram(t: Tables) -> DataFrame:
    return t.user_jobs.groupBy("user_id", "stage").agg(F.count("*").alias("n"))


@query("SELECT user_id, category, count(*) AS n FROM (SELECT user_id, unnest(categories) AS category FROM user_jobs WHERE stage <> 'excluded') GROUP BY ALL")
def category_histogram(t: Tables) -> DataFrame:
    return t.user_jobs.where("stage <> 'excluded'").select("user_id", F.explode("categories").alias("category")).groupBy("user_id", "category").agg(F.count("*").alias("n"))


@query("SELECT exclude_reason, count(*) AS n FROM user_jobs WHERE stage = 'excluded' GROUP BY ALL")
def posting_excluded_by_reason(t: Tables) -> DataFrame:
    return t.user_jobs.where("stage = 'excluded'").groupBy("exclude_reason").agg(F.count("*").alias("n"))


@query("SELECT status, count(*) AS n FROM applications WHERE user_id = 0 OR user_id = 3 GROUP BY ALL")
def status_histogram(t: Tables) -> DataFrame:
    return t.applications.where(F.col("user_id").isin(0, 3)).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM posts WHERE status = 'visible') GROUP BY tag")
def tag_counts(t: Tables) -> DataFrame:
    return t.posts.where("status = 'visible'").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def dense_days(rows: DataFrame, ts: str, now: str, days: int = 14, zone: str = "UTC") -> DataFrame:
    """Rows (day, n) for each of the last ``days`` local days up to ``now``, none before the first row's; days without rows count 0."""
    local = lambda x: F.to_date(F.from_utc_timestamp(x, zone))
    counts = rows.groupBy(local(F.col(ts)).alias("day")).agg(F.count("*").alias("n"))
    today = local(F.to_timestamp(F.lit(now)))
    spine = rows.agg(F.min(local(F.col(ts))).alias("first")).select(F.explode(F.sequence(F.greatest("first", F.date_sub(today, days - 1)), today)).alias("day"))
    return spine.join(counts, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def _dense_sql(local: str, today: str) -> str:
    return f"""
, counted AS (SELECT {local} AS day, count(*) AS n FROM usage GROUP BY 1)
SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n
FROM (SELECT CAST(unnest(generate_series(greatest((SELECT min(day) FROM counted), DATE '{today}' - 13), TIMESTAMP '{today}', INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN counted ON counted.day = s.day"""


@query(_dense_sql("CAST(created_at AS DATE)", "2024-01-30"))
def new_per_day_dense(t: Tables) -> DataFrame:
    return dense_days(t.usage, "created_at", EVENT_NOW)


@query(_dense_sql("CAST(created_at - INTERVAL 6 HOUR AS DATE)", "2024-01-30"))
def new_per_day_local(t: Tables) -> DataFrame:
    """The same in a user's time zone; January in Chicago is six hours behind."""
    return dense_days(t.usage, "created_at", EVENT_NOW, zone="America/Chicago")


@query(f"""
SELECT (SELECT count(*) FROM companies WHERE enabled) AS companies, (SELECT count(*) FROM companies WHERE last_fetch_ok = false) AS failing,
  (SELECT count(*) FROM jobs WHERE closed_at IS NULL) AS open_jobs, (SELECT count(*) FROM user_jobs WHERE stage = 'pending_score') AS pending,
  (SELECT count(*) FROM analyses WHERE kind = 'deep') AS deep, (SELECT count(DISTINCT user_id) FROM usage WHERE created_at > TIMESTAMP '{EVENT_NOW}' - INTERVAL 7 DAY) AS active_users,
  (SELECT CAST(sum(cost_cents) AS BIGINT) FROM usage) AS cost_cents""")
def overview_one_row(t: Tables) -> DataFrame:
    """One aggregate over each table; their single rows become one through scalar subqueries."""
    week = F.to_timestamp(F.lit(EVENT_NOW)) - F.expr("INTERVAL 7 DAYS")
    metrics = {
        "companies": t.companies.where("enabled").agg(F.count("*")),
        "failing": t.companies.where(F.col("last_fetch_ok") == F.lit(False)).agg(F.count("*")),
        "open_jobs": t.jobs.where("closed_at IS NULL").agg(F.count("*")),
        "pending": t.user_jobs.where("stage = 'pending_score'").agg(F.count("*")),
        "deep": t.analyses.where("kind = 'deep'").agg(F.count("*")),
        "active_users": t.usage.where(F.col("created_at") > week).agg(F.countDistinct("user_id")),
        "cost_cents": t.usage.agg(F.sum("cost_cents")),
    }
    return t.spark.range(1).select(*[df.scalar().alias(name) for name, df in metrics.items()])


@query("""
SELECT (SELECT count(*) FROM companies WHERE enabled) AS companies, (SELECT count(*) FROM jobs WHERE closed_at IS NULL) AS open_jobs,
  (SELECT count(*) FROM filings) AS filings, (SELECT count(DISTINCT employer_key) FROM filings) AS employers""")
def public_one_row(t: Tables) -> DataFrame:
    filings = t.filings
    metrics = {
        "companies": t.companies.where("enabled").agg(F.count("*")),
        "open_jobs": t.jobs.where("closed_at IS NULL").agg(F.count("*")),
        "filings": filings.agg(F.count("*")),
        "employers": filings.agg(F.countDistinct("employer_key")),
    }
    return t.spark.range(1).select(*[df.scalar().alias(name) for name, df in metrics.items()])


@query(f"""
, users AS (SELECT DISTINCT user_id FROM user_jobs), month AS (
  SELECT user_id, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM usage WHERE date_trunc('month', created_at) = date_trunc('month', TIMESTAMP '{EVENT_NOW}') GROUP BY user_id
)
SELECT u.user_id, (SELECT count(*) FROM user_jobs j WHERE j.user_id = u.user_id AND j.stage = 'scored') AS scored,
  (SELECT count(*) FROM user_jobs j WHERE j.user_id = u.user_id AND j.stage = 'pending_score') AS pending,
  (SELECT count(*) FROM applications a WHERE a.user_id = u.user_id) AS tracked,
  (SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S') FROM analyses a WHERE a.user_id = u.user_id) AS last_analysis,
  coalesce(m.cost_cents, 0) AS month_cents
FROM users u LEFT JOIN month m ON m.user_id = u.user_id""")
def user_profile_wide(t: Tables) -> DataFrame:
    """Admin profiles; the month's spend here counts calls only, unlike ``month_spend``."""
    stages = t.user_jobs.groupBy("user_id").agg(F.count(F.when(F.col("stage") == "scored", 1)).alias("scored"), F.count(F.when(F.col("stage") == "pending_score", 1)).alias("pending"))
    tracked = t.applications.groupBy("user_id").agg(F.count("*").alias("tracked"))
    last = t.analyses.groupBy("user_id").agg(stamp(F.max("created_at")).alias("last_analysis"))
    month = t.usage.where(F.date_trunc("month", "created_at") == F.date_trunc("month", F.to_timestamp(F.lit(EVENT_NOW)))).groupBy("user_id").agg(F.sum("cost_cents").alias("month_cents"))
    rows = stages.join(tracked, "user_id", "left").join(last, "user_id", "left").join(month, "user_id", "left")
    return rows.fillna(0, ["tracked", "month_cents"])


def wage_percentile(q: float):
    """Interpolated percentile of the wage, over whole cents: exact for the quarters, whatever the engine."""
    return F.percentile(F.round(F.col("wage_from") * 100).cast("long"), q) / 100


@query("""
SELECT employer_key, count(*) AS filings, count(*) FILTER (new_employment) AS new_hires, quantile_cont(round(wage_from * 100)::BIGINT, 0.25) / 100 AS p25,
  quantile_cont(round(wage_from * 100)::BIGINT, 0.5) / 100 AS median, quantile_cont(round(wage_from * 100)::BIGINT, 0.75) / 100 AS p75, min(wage_from) AS lowest, max(wage_from) AS highest
FROM filings GROUP BY employer_key""")
def employer_detail(t: Tables) -> DataFrame:
    wage = F.col("wage_from")
    names = ("p25", "median", "p75")
    found = t.filings.groupBy("employer_key").agg(
        F.count("*").alias("filings"),
        F.count(F.when(F.col("new_employment"), 1)).alias("new_hires"),
        F.percentile(F.round(wage * 100).cast("long"), [0.25, 0.5, 0.75]).alias("q"),
        F.min(wage).alias("lowest"),
        F.max(wage).alias("highest"),
    )
    return found.select("employer_key", "filings", "new_hires", *[(F.col("q")[i] / 100).alias(name) for i, name in enumerate(names)], "lowest", "highest")


def _top_sql(column: str, n: int) -> str:
    return f"""
SELECT employer_key, {column}, n, median FROM (
  SELECT employer_key, {column}, count(*) AS n, quantile_cont(round(wage_from * 100)::BIGINT, 0.5) / 100 AS median, row_number() OVER (PARTITION BY employer_key ORDER BY count(*) DESC, {column}) AS r
  FROM filings GROUP BY employer_key, {column}
) WHERE r <= {n}"""


def top_breakdown(filings: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of ``column`` of each employer with their median wage."""
    counts = filings.groupBy("employer_key", column).agg(F.count("*").alias("n"), wage_percentile(0.5).alias("median"))
    return first_per_key(counts, ["employer_key"], F.desc("n"), F.asc(column), n=n)


@query(_top_sql("job_title", 5))
def employer_titles(t: Tables) -> DataFrame:
    return top_breakdown(t.filings, "job_title", 5)


@query(_top_sql("place", 8))
def employer_places(t: Tables) -> DataFrame:
    return top_breakdown(t.filings, "place", 8)


@query(_top_sql("wage_level", 4))
def employer_levels(t: Tables) -> DataFrame:
    return top_breakdown(t.filings, "wage_level", 4)


@query("""
, named AS (SELECT employer_key, employer_name, count(*) AS n FROM filings WHERE starts_with(employer_key, 'supplier#00000') GROUP BY ALL)
SELECT employer_key, CAST(sum(n) AS BIGINT) AS filings, (list(employer_name ORDER BY n DESC, employer_name))[1] AS name FROM named GROUP BY employer_key
ORDER BY employer_key = 'supplier#000000012' DESC, starts_with(employer_key, 'supplier#000000') DESC, filings DESC, employer_key LIMIT 20""")
def employer_search(t: Tables) -> DataFrame:
    """Exact name first, then by prefix, then by volume; the name is the most frequent one, ties to the smallest."""
    wanted = "supplier#000000012"
    named = t.filings.where(F.col("employer_key").startswith("supplier#00000")).groupBy("employer_key", "employer_name").agg(F.count("*").alias("n"))
    found = named.groupBy("employer_key").agg(F.sum("n").alias("filings"), F.min(F.struct((-F.col("n")).alias("n"), "employer_name"))["employer_name"].alias("name"))
    return found.orderBy((F.col("employer_key") == wanted).desc(), F.col("employer_key").startswith("supplier#000000").desc(), F.desc("filings"), "employer_key").limit(20)


@query("""
SELECT employer_key, s[CAST(floor(0.1 * (len(s) - 1) + 0.5) AS INTEGER) + 1] AS p10, s[CAST(floor(0.5 * (len(s) - 1) + 0.5) AS INTEGER) + 1] AS p50,
  s[CAST(floor(0.9 * (len(s) - 1) + 0.5) AS INTEGER) + 1] AS p90
FROM (SELECT employer_key, list(wage_from ORDER BY wage_from) FILTER (wage_from IS NOT NULL) AS s FROM filings WHERE fiscal_year = 1998 GROUP BY employer_key)""")
def wage_quantiles_nearest(t: Tables) -> DataFrame:
    wages = t.filings.where("fiscal_year = 1998").select("employer_key", "wage_from")
    return nearest_ranks(wages, "employer_key", "wage_from", {f"p{round(100 * q)}": q for q in (0.1, 0.5, 0.9)})


SPONSOR_SQL = """
, latest AS (
  SELECT job_id, sponsorship, quote, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC, quote ASC NULLS LAST) AS r FROM analyses WHERE sponsorship IS NOT NULL
), filed AS (SELECT employer_id, count(*) AS filings FROM filings GROUP BY employer_id
), signals AS (
  SELECT c.id, c.name, count(*) FILTER (l.sponsorship = 'yes') AS yes, count(*) FILTER (l.sponsorship = 'no') AS no,
    count(l.sponsorship) AS judged, (list(l.quote ORDER BY j.last_seen_at DESC, j.id DESC) FILTER (l.quote IS NOT NULL))[1] AS quote, coalesce(max(f.filings), 0) AS filings
  FROM companies c JOIN jobs j ON j.company_id = c.id LEFT JOIN latest l ON l.job_id = j.id AND l.r = 1 LEFT JOIN filed f ON f.employer_id = c.id
  GROUP BY c.id, c.name HAVING count(l.sponsorship) > 0 OR max(f.filings) > 0
), labelled AS (
  SELECT *, CASE WHEN yes > 0 AND no > 0 THEN 'mixed' WHEN yes > 0 THEN 'sponsors' WHEN no > 0 THEN 'does_not_sponsor' ELSE 'unclear' END AS signal FROM signals
)"""


@query(SPONSOR_SQL + "SELECT id, name, yes, no, judged, quote, filings, signal FROM labelled")
def sponsor_rollup(t: Tables) -> DataFrame:
    """What each company's latest judged postings say about sponsorship, with its filings.

    Ids of analyses may repeat; the SQL leaves open which of two alike comes first, here the last word by name does.
    """
    latest = first_per_key(t.analyses.where("sponsorship IS NOT NULL"), ["job_id"], F.desc("created_at"), F.desc("id"), F.asc_nulls_last("quote"), F.desc("sponsorship")).select("job_id", "sponsorship", "quote")
    jobs = t.jobs.select("id", "company_id", "last_seen_at").join(latest, F.col("id") == F.col("job_id"), "left")
    says = lambda v: F.count(F.when(F.col("sponsorship") == v, 1))
    quoted = F.when(F.col("quote").isNotNull(), F.struct("last_seen_at", "id", "quote"))
    signals = jobs.groupBy("company_id").agg(says("yes").alias("yes"), says("no").alias("no"), F.count("sponsorship").alias("judged"), F.max(quoted)["quote"].alias("quote"))
    filed = t.filings.groupBy("employer_id").agg(F.count("*").alias("filings"))
    rows = t.companies.select("id", "name").join(signals, F.col("id") == F.col("company_id")).join(filed, F.col("id") == F.col("employer_id"), "left")
    rows = rows.withColumn("filings", F.coalesce("filings", F.lit(0))).where("judged > 0 OR filings > 0")
    yes, no = F.col("yes") > 0, F.col("no") > 0
    signal = F.when(yes & no, "mixed").when(yes, "sponsors").when(no, "does_not_sponsor").otherwise("unclear")
    return rows.select("id", "name", "yes", "no", "judged", "quote", "filings", signal.alias("signal"))


@query(SPONSOR_SQL + "SELECT signal, count(*) AS companies, CAST(sum(filings) AS BIGINT) AS filings FROM labelled GROUP BY signal")
def sponsor_signal_summary(t: Tables) -> DataFrame:
    return sponsor_rollup(t).groupBy("signal").agg(F.count("*").alias("companies"), F.sum("filings").alias("filings"))


@query("SELECT strftime(min(decision_date), '%Y-%m-%d') AS first_day, strftime(max(decision_date), '%Y-%m-%d') AS last_day, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year FROM filings")
def filing_period(t: Tables) -> DataFrame:
    return t.filings.agg(day(F.min("decision_date")).alias("first_day"), day(F.max("decision_date")).alias("last_day"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))


@query(f"SELECT count(*) AS queued, count(*) FILTER (created_at > TIMESTAMP '{EVENT_NOW}' - INTERVAL 1 HOUR) AS last_hour FROM usage WHERE kind = 'signup'")
def recent_mail_count(t: Tables) -> DataFrame:
    hour = F.to_timestamp(F.lit(EVENT_NOW)) - F.expr("INTERVAL 1 HOUR")
    return t.usage.where("kind = 'signup'").agg(F.count("*").alias("queued"), F.count(F.when(F.col("created_at") > hour, 1)).alias("last_hour"))


@query("""
SELECT kind, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt, CAST(sum(completion_tokens) AS BIGINT) AS completion,
  CAST(sum(greatest(prompt_tokens - cached_tokens, 0) * 15 + least(cached_tokens, prompt_tokens) * 4 + completion_tokens * 60) AS BIGINT) AS cost_units FROM analyses GROUP BY kind""")
def call_cost(t: Tables) -> DataFrame:
    """Token totals and their price by kind, in whole price units: uncached, cached and completion tokens cost differently."""
    prompt, cached = F.col("prompt_tokens"), F.col("cached_tokens")
    units = F.greatest(prompt - cached, F.lit(0)) * 15 + F.least(cached, prompt) * 4 + F.col("completion_tokens") * 60
    return t.analyses.groupBy("kind").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.sum(units).alias("cost_units"))


@query(f"SELECT id FROM jobs WHERE closed_at IS NULL AND first_seen_at >= TIMESTAMP '{POSTING_NOW}' - INTERVAL 30 DAY")
def open_recent(t: Tables) -> DataFrame:
    since = F.to_timestamp(F.lit(POSTING_NOW)) - F.expr("INTERVAL 30 DAYS")
    return t.jobs.where(F.col("closed_at").isNull() & (F.col("first_seen_at") >= since)).select("id")


@query("""
SELECT id, name, CASE WHEN id % 4 = 0 THEN 'a' ELSE 'b' END AS kind, rank() OVER (PARTITION BY industry ORDER BY name) AS place FROM companies WHERE enabled""")
def company_places(t: Tables) -> DataFrame:
    place = F.rank().over(Window.partitionBy("industry").orderBy("name"))
    return t.companies.where("enabled").select("id", "name", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("kind"), place.alias("place"))
