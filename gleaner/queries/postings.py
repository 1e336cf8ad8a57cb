"""Posting lists, queues, latest rows, versioned joins and the lifecycle of the posting table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.latest import budget_cut, first_per_key, page, page_size
from gleaner.operators.merge import classify, save_listing, stale_or_missing, upsert
from gleaner.plans.tables import EVENT_NOW, POSTING_NOW, Tables
from gleaner.queries.register import registry

QUERIES, ORACLES, query = registry()


def day(ts):
    return F.date_format(ts, "yyyy-MM-dd")


@dataclass
class JobQuery:
    """What a caller asks of the posting list; an unset field gives no predicate."""

    user_id: int
    stages: list[str] = field(default_factory=lambda: ["scored", "pending_score"])
    category: str | None = None
    text: str | None = None
    company_id: int | None = None
    least_score: int | None = None
    since: str | None = None
    open_only: bool = True
    newest: bool = False
    limit: int = 0
    offset: int = 0

    def predicate(self) -> Column:
        """The conjunction of the fields that are set; % and _ of the text stay wildcards."""
        parts = [F.col("user_id") == self.user_id, F.col("stage").isin(self.stages)]
        if self.category is not None:
            parts.append(F.array_contains("categories", self.category))
        if self.text is not None:
            pattern = f"%{self.text.lower()}%"
            parts.append(F.lower("title").like(pattern) | F.lower("company").like(pattern))
        if self.company_id is not None:
            parts.append(F.col("company_id") == self.company_id)
        if self.least_score is not None:
            parts.append(F.col("score") >= self.least_score)
        if self.since is not None:
            parts.append(F.col("first_seen_at") >= F.to_timestamp(F.lit(self.since)))
        if self.open_only:
            parts.append(F.col("closed_at").isNull())
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


def newest_score(t: Tables) -> DataFrame:
    """The best-known score of each job: of its newest analysis of kind score, ties to the larger id and score."""
    rows = t.analyses.where("kind = 'score'").select("job_id", "score", "created_at", "id")
    return rows.groupBy("job_id").agg(F.max(F.struct("created_at", "id", "score"))["score"].alias("score"))


def job_views(t: Tables, hidden: DataFrame | None = None) -> DataFrame:
    """The joined posting view of every user's outcomes, without companies that the user hides."""
    companies = t.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "industry")
    rows = t.user_jobs.join(t.jobs.withColumnsRenamed({"id": "job_id"}).drop("content_hash"), "job_id").join(companies, "company_id")
    rows = rows.join(newest_score(t), "job_id", "left").join(t.applications, ["user_id", "job_id"], "left")
    return rows.join(hidden, ["user_id", "company_id"], "left_anti") if hidden is not None else rows


def list_jobs(t: Tables, q: JobQuery, hidden: DataFrame | None = None) -> DataFrame:
    rows = job_views(t, hidden).where(q.predicate())
    order = [F.desc("first_seen_at"), F.asc("job_id")] if q.newest else [F.desc_nulls_last("score"), F.desc("estimate"), F.desc("first_seen_at"), F.asc("job_id")]
    return page(rows, order, page_size(q.limit), q.offset).select("job_id", "title", "company", "score", "estimate", "status")


def hidden_companies(t: Tables) -> DataFrame:
    return t.companies.where("id % 9 = 0").select(F.lit(3).cast("long").alias("user_id"), F.col("id").alias("company_id"))


VIEW_SQL = """
, newest AS (SELECT job_id, score FROM (SELECT job_id, score, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC, score DESC) AS r FROM analyses WHERE kind = 'score') WHERE r = 1
), views AS (
  SELECT u.user_id, u.job_id, u.stage, u.categories, u.exclude_reason, u.estimate, j.title, j.first_seen_at, j.closed_at, c.id AS company_id, c.name AS company, n.score, a.status
  FROM user_jobs u JOIN jobs j ON j.id = u.job_id JOIN companies c ON c.id = j.company_id LEFT JOIN newest n ON n.job_id = u.job_id
  LEFT JOIN applications a ON a.user_id = u.user_id AND a.job_id = u.job_id
)"""
COLUMNS = "job_id, title, company, score, estimate, status"
VISIBLE = "user_id = 3 AND company_id % 9 <> 0"


@query(VIEW_SQL + f"SELECT {COLUMNS} FROM views WHERE {VISIBLE} AND stage IN ('scored', 'pending_score') AND closed_at IS NULL AND list_contains(categories, 'o') AND (lower(title) LIKE '%urg%' OR lower(company) LIKE '%urg%') ORDER BY score DESC NULLS LAST, estimate DESC, first_seen_at DESC, job_id LIMIT 50 OFFSET 5")
def posting_list_filtered(t: Tables) -> DataFrame:
    return list_jobs(t, JobQuery(3, category="o", text="urg", offset=5), hidden_companies(t))


@query(VIEW_SQL + f"SELECT {COLUMNS} FROM views WHERE {VISIBLE} AND stage IN ('scored', 'pending_score') AND first_seen_at >= TIMESTAMP '2000-01-01' AND score >= 40 ORDER BY first_seen_at DESC, job_id LIMIT 200")
def posting_list_newest(t: Tables) -> DataFrame:
    return list_jobs(t, JobQuery(3, since="2000-01-01 00:00:00", least_score=40, open_only=False, newest=True, limit=5000), hidden_companies(t))


def review_queue(rows: DataFrame, limit: int) -> DataFrame:
    """Scored jobs first, best first; pending ones fill up by estimate, at most 30 of them."""
    scored = rows.where("stage = 'scored' AND score IS NOT NULL").orderBy(F.desc("score"), F.desc("first_seen_at"), "job_id").limit(limit)
    pending = rows.where("stage = 'pending_score'").orderBy(F.desc("estimate"), F.desc("first_seen_at"), "job_id").limit(min(limit, 30))
    both = scored.withColumn("part", F.lit(0)).unionByName(pending.withColumn("part", F.lit(1)))
    return both.orderBy("part", F.desc_nulls_last(F.when(F.col("part") == 0, F.col("score"))), F.desc("estimate"), F.desc("first_seen_at"), "job_id").limit(limit)


@query(VIEW_SQL + f"""
, scored AS (SELECT *, 0 AS part FROM views WHERE {VISIBLE} AND closed_at IS NULL AND status IS NULL AND stage = 'scored' AND score IS NOT NULL ORDER BY score DESC, first_seen_at DESC, job_id LIMIT 1000),
pending AS (SELECT *, 1 AS part FROM views WHERE {VISIBLE} AND closed_at IS NULL AND status IS NULL AND stage = 'pending_score' ORDER BY estimate DESC, first_seen_at DESC, job_id LIMIT 30)
SELECT job_id, part, coalesce(b.score, -1) AS score, estimate FROM (SELECT * FROM scored UNION ALL SELECT * FROM pending) b ORDER BY part, CASE WHEN part = 0 THEN b.score END DESC NULLS LAST, estimate DESC, first_seen_at DESC, job_id LIMIT 1000""")
def posting_review_queue(t: Tables) -> DataFrame:
    rows = job_views(t, hidden_companies(t)).where("user_id = 3 AND closed_at IS NULL AND status IS NULL")
    return review_queue(rows, 1000).select("job_id", "part", F.coalesce("score", F.lit(-1)).alias("score"), "estimate")


@query(VIEW_SQL + """
SELECT user_id, job_id, score, new_jobs FROM (
  SELECT user_id, job_id, score, count(*) OVER (PARTITION BY user_id) AS new_jobs, row_number() OVER (PARTITION BY user_id ORDER BY (CASE WHEN score >= 60 THEN score END) DESC NULLS LAST, job_id) AS r
  FROM views WHERE stage = 'scored' AND closed_at IS NULL AND first_seen_at >= TIMESTAMP '2001-01-01'
) WHERE r <= 8 AND score >= 60""")
def posting_digest(t: Tables) -> DataFrame:
    """Of each user's jobs since a day: how many, and the best eight that score 60 or more; users without any get no row."""
    rows = job_views(t).where(F.col("closed_at").isNull() & (F.col("stage") == "scored") & (F.col("first_seen_at") >= F.to_timestamp(F.lit("2001-01-01 00:00:00"))))
    counted = rows.groupBy("user_id").agg(F.count("*").alias("new_jobs"))
    best = first_per_key(rows.where("score >= 60"), ["user_id"], F.desc("score"), F.asc("job_id"), n=8)
    return best.join(counted, "user_id").select("user_id", "job_id", "score", "new_jobs")


@query(VIEW_SQL + "SELECT job_id, exclude_reason, title FROM views WHERE user_id = 3 AND stage = 'excluded' AND exclude_reason = 'title:senior' ORDER BY first_seen_at DESC, job_id LIMIT 100")
def posting_excluded(t: Tables) -> DataFrame:
    rows = job_views(t).where("user_id = 3 AND stage = 'excluded' AND exclude_reason = 'title:senior'")
    return page(rows, [F.desc("first_seen_at"), F.asc("job_id")], 100).select("job_id", "exclude_reason", "title")


@query("""
, cached AS (SELECT DISTINCT job_id, profile_hash FROM analyses WHERE kind = 'score')
SELECT u.job_id, c.job_id IS NOT NULL AS reusable FROM user_jobs u JOIN jobs j ON j.id = u.job_id LEFT JOIN cached c ON c.job_id = u.job_id AND c.profile_hash = u.job_id % 97
WHERE u.stage = 'pending_score' AND j.closed_at IS NULL AND NOT EXISTS (SELECT 1 FROM applications a WHERE a.job_id = u.job_id AND a.user_id = u.user_id)""")
def pending_with_cached(t: Tables) -> DataFrame:
    """Pending jobs that are not tracked, and whether an analysis under the same key can be reused."""
    cached = t.analyses.where("kind = 'score'").select("job_id", F.col("profile_hash").alias("key")).distinct().withColumn("reusable", F.lit(True))
    open_jobs = t.jobs.where("closed_at IS NULL").select(F.col("id").alias("job_id"))
    rows = t.user_jobs.where("stage = 'pending_score'").join(open_jobs, "job_id", "left_semi").join(t.applications.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")
    rows = rows.withColumn("key", F.col("job_id") % 97).join(cached, ["job_id", "key"], "left")
    return rows.select("job_id", F.coalesce("reusable", F.lit(False)).alias("reusable"))


@query("SELECT u.job_id FROM user_jobs u WHERE u.stage = 'scored' AND NOT EXISTS (SELECT 1 FROM analyses a WHERE a.job_id = u.job_id AND a.kind = 'score' AND a.profile_hash = u.job_id % 97 + 1)")
def pending_stale(t: Tables) -> DataFrame:
    """Scored jobs without an analysis under the current key."""
    current = t.analyses.where("kind = 'score'").select("job_id", F.col("profile_hash").alias("key"))
    return t.user_jobs.where("stage = 'scored'").withColumn("key", F.col("job_id") % 97 + 1).join(current, ["job_id", "key"], "left_anti").select("job_id")


@query("SELECT u.job_id, u.stage FROM user_jobs u JOIN jobs j ON j.id = u.job_id WHERE u.user_id = 3 AND u.stage <> 'excluded' ORDER BY u.stage = 'pending_score' DESC, j.first_seen_at DESC, u.job_id LIMIT 40")
def bench_candidates(t: Tables) -> DataFrame:
    rows = t.user_jobs.where("user_id = 3 AND stage <> 'excluded'").join(t.jobs.select(F.col("id").alias("job_id"), "first_seen_at"), "job_id")
    return rows.orderBy((F.col("stage") == "pending_score").desc(), F.desc("first_seen_at"), "job_id").limit(40).select("job_id", "stage")


@query(VIEW_SQL + "SELECT v.job_id, v.score FROM views v WHERE v.user_id = 3 AND v.stage = 'scored' AND v.score >= 70 AND NOT EXISTS (SELECT 1 FROM analyses d WHERE d.job_id = v.job_id AND d.kind = 'deep') ORDER BY v.score DESC, v.job_id LIMIT 25")
def deep_candidates(t: Tables) -> DataFrame:
    deep = t.analyses.where("kind = 'deep'").select("job_id")
    rows = job_views(t).where("user_id = 3 AND stage = 'scored' AND score >= 70").join(deep, "job_id", "left_anti")
    return rows.orderBy(F.desc("score"), "job_id").limit(25).select("job_id", "score")


@query("SELECT job_id, max(score) AS score, day FROM (SELECT job_id, score, strftime(created_at, '%Y-%m-%d') AS day, rank() OVER (PARTITION BY job_id ORDER BY created_at DESC) AS r FROM analyses WHERE kind = 'deep') WHERE r = 1 GROUP BY job_id, day")
def deep_latest(t: Tables) -> DataFrame:
    """The newest deep analysis of each job; of several at one time the one with the best score."""
    newest = t.analyses.where("kind = 'deep'").groupBy("job_id").agg(F.max(F.struct("created_at", "score")).alias("last"))
    return newest.select("job_id", "last.score", day("last.created_at").alias("day"))


@query("""
, latest AS (SELECT *, row_number() OVER (PARTITION BY user_id, domain, question_id ORDER BY created_at DESC, id DESC) AS r FROM attempts)
SELECT user_id, domain, count(*) AS answered, count(*) FILTER (correct) AS right_now FROM latest WHERE r = 1 GROUP BY user_id, domain""")
def latest_attempt_domains(t: Tables) -> DataFrame:
    """How many questions of a domain a user has answered, and how many rightly at the last attempt."""
    last = t.attempts.groupBy("user_id", "domain", "question_id").agg(F.max(F.struct("created_at", "id", "correct"))["correct"].alias("correct"))
    return last.groupBy("user_id", "domain").agg(F.count("*").alias("answered"), F.count(F.when(F.col("correct"), 1)).alias("right_now"))


@query("""
, latest AS (SELECT question_id, correct, row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, id DESC) AS r FROM attempts WHERE user_id = 7)
SELECT p.p_partkey AS question_id, CASE WHEN l.question_id IS NULL THEN 0 WHEN NOT l.correct THEN 1 ELSE 2 END AS priority
FROM part p LEFT JOIN latest l ON l.question_id = p.p_partkey AND l.r = 1 ORDER BY priority, question_id LIMIT 60""")
def quiz_priority(t: Tables) -> DataFrame:
    """Unanswered questions first, then those answered wrongly, then the rest; a fixed order stands for chance."""
    last = first_per_key(t.attempts.where("user_id = 7"), ["question_id"], F.desc("created_at"), F.desc("id")).select("question_id", "correct")
    rows = t.raw("part").select(F.col("p_partkey").alias("question_id")).join(last, "question_id", "left")
    priority = F.when(F.col("correct").isNull(), 0).when(~F.col("correct"), 1).otherwise(2)
    return rows.select("question_id", priority.alias("priority")).orderBy("priority", "question_id").limit(60)


@query("SELECT job_id, score FROM (SELECT job_id, score, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC, score DESC) AS r FROM analyses WHERE kind = 'score') WHERE r = 1")
def newest_score_per_key(t: Tables) -> DataFrame:
    return newest_score(t)


@query("""
, firsts AS (SELECT user_id, job_id, min(created_at) AS first_at FROM analyses WHERE kind = 'score' GROUP BY ALL)
SELECT user_id, count(*) AS scored_jobs, count(*) FILTER (first_at > TIMESTAMP '2001-06-01' - INTERVAL 30 DAY AND first_at <= TIMESTAMP '2001-06-01') AS recent FROM firsts GROUP BY user_id""")
def first_score_rolling(t: Tables) -> DataFrame:
    """First scores of jobs in the trailing window; a rescore is not a first score."""
    now = F.to_timestamp(F.lit("2001-06-01 00:00:00"))
    firsts = t.analyses.where("kind = 'score'").groupBy("user_id", "job_id").agg(F.min("created_at").alias("first_at"))
    recent = (F.col("first_at") > now - F.expr("INTERVAL 30 DAYS")) & (F.col("first_at") <= now)
    return firsts.groupBy("user_id").agg(F.count("*").alias("scored_jobs"), F.count(F.when(recent, 1)).alias("recent"))


@query("SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM usage) WHERE r <= 20")
def keep_newest_n(t: Tables) -> DataFrame:
    return first_per_key(t.usage, ["user_id"], F.desc("created_at"), F.desc("id"), n=20).select("user_id", "id")


@query("SELECT id, kind FROM usage WHERE id < 900 ORDER BY id DESC LIMIT 50")
def keyset_page(t: Tables) -> DataFrame:
    return t.usage.where("id < 900").orderBy(F.desc("id")).limit(50).select("id", "kind")


@query("""
SELECT kind, id, author FROM (
  SELECT 'post' AS kind, id, author_id AS author FROM posts UNION ALL SELECT 'event', id, user_id FROM usage WHERE kind = 'error' UNION ALL SELECT 'turn', conv_id * 100 + turn, conv_id FROM conversations
) ORDER BY id DESC, kind LIMIT 100""")
def content_union_feed(t: Tables) -> DataFrame:
    posts = t.posts.select(F.lit("post").alias("kind"), "id", F.col("author_id").alias("author"))
    errors = t.usage.where("kind = 'error'").select(F.lit("event").alias("kind"), "id", F.col("user_id").alias("author"))
    turns = t.raw("conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("author"))
    return posts.unionByName(errors).unionByName(turns).orderBy(F.desc("id"), "kind").limit(100)


@query("SELECT j.id FROM jobs j LEFT JOIN user_jobs u ON u.job_id = j.id AND u.user_id = 3 WHERE j.closed_at IS NULL AND (u.job_id IS NULL OR u.content_hash <> j.content_hash)")
def stale_jobs(t: Tables) -> DataFrame:
    """Open jobs without a current outcome for a user: none yet, or one for older content."""
    outcomes = t.user_jobs.where("user_id = 3").select(F.col("job_id").alias("id"), "content_hash")
    return stale_or_missing(t.jobs.where("closed_at IS NULL").select("id", "content_hash"), outcomes, ["id"], "content_hash").select("id")


@query("SELECT j.id, u.stage FROM jobs j JOIN user_jobs u ON u.job_id = j.id AND u.content_hash = j.content_hash")
def current_version(t: Tables) -> DataFrame:
    outcomes = t.user_jobs.select(F.col("job_id").alias("id"), "content_hash", "stage")
    return t.jobs.select("id", "content_hash").join(outcomes, ["id", "content_hash"]).select("id", "stage")


@query("SELECT id, name FROM companies WHERE id % 9 <> 0")
def hidden_anti(t: Tables) -> DataFrame:
    return t.companies.join(hidden_companies(t).select(F.col("company_id").alias("id")), "id", "left_anti").select("id", "name")


@query("SELECT id, name FROM companies c WHERE EXISTS (SELECT 1 FROM jobs j JOIN applications a ON a.job_id = j.id WHERE j.company_id = c.id AND a.status = 'interviewing')")
def visible_semi(t: Tables) -> DataFrame:
    tracked = t.jobs.select("id", "company_id").join(t.applications.where("status = 'interviewing'"), F.col("id") == F.col("job_id")).select(F.col("company_id").alias("id"))
    return t.companies.join(tracked, "id", "left_semi").select("id", "name")


def stored_and_listed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A stored posting table and a new listing from the orders: two thirds are stored, four fifths are listed, some with new content."""
    columns = ["source", "ext_id", "title", "content_hash", "first_seen_at", "last_seen_at", "closed_at"]
    stored = t.jobs.where("id % 3 <> 0").select(*columns)
    listed = t.jobs.where("id % 5 <> 0").select("source", "ext_id", F.concat("title", F.lit("!")).alias("title"), F.when(F.col("id") % 7 == 0, F.col("content_hash") + 1).otherwise(F.col("content_hash")).alias("content_hash"))
    return stored, listed


LISTING_SQL = """
, stored AS (SELECT * FROM jobs WHERE id % 3 <> 0), listed AS (SELECT source, ext_id, title || '!' AS title, CASE WHEN id % 7 = 0 THEN content_hash + 1 ELSE content_hash END AS content_hash FROM jobs WHERE id % 5 <> 0)
, diff AS (SELECT coalesce(s.source, l.source) AS source, coalesce(s.ext_id, l.ext_id) AS ext_id, s.ext_id IS NOT NULL AS is_stored, l.ext_id IS NOT NULL AS is_listed,
  s.content_hash AS old_hash, l.content_hash AS new_hash, s.closed_at, s.title AS old_title, l.title AS new_title, s.first_seen_at, s.last_seen_at FROM stored s FULL JOIN listed l ON s.source = l.source AND s.ext_id = l.ext_id)"""


@query(LISTING_SQL + """
SELECT source, ext_id, CASE WHEN NOT is_stored THEN 'new' WHEN NOT is_listed THEN 'missing' WHEN old_hash <> new_hash THEN 'changed' WHEN closed_at IS NOT NULL THEN 'reopened' ELSE 'unchanged' END AS change FROM diff""")
def lifecycle_classify(t: Tables) -> DataFrame:
    return classify(*stored_and_listed(t), ["source", "ext_id"])


@query(LISTING_SQL + f"""
SELECT source, ext_id, CASE WHEN is_listed AND (NOT is_stored OR old_hash <> new_hash) THEN new_title ELSE old_title END AS title,
  CASE WHEN is_listed AND (NOT is_stored OR old_hash <> new_hash) THEN new_hash ELSE old_hash END AS content_hash,
  strftime(CASE WHEN is_stored THEN first_seen_at ELSE TIMESTAMP '{POSTING_NOW}' END, '%Y-%m-%d') AS first_day, strftime(CASE WHEN is_listed THEN TIMESTAMP '{POSTING_NOW}' ELSE last_seen_at END, '%Y-%m-%d') AS last_day,
  strftime(CASE WHEN is_listed THEN NULL WHEN closed_at IS NULL AND source <> 'manual' AND source <> 'board3' THEN TIMESTAMP '{POSTING_NOW}' ELSE closed_at END, '%Y-%m-%d') AS closed_day FROM diff""")
def lifecycle_upsert(t: Tables) -> DataFrame:
    """The posting table after a listing; the listing of board3 was partial, so nothing of it is closed."""
    stored, listed = stored_and_listed(t)
    now = F.to_timestamp(F.lit(POSTING_NOW))
    rows = save_listing(stored, listed, now, complete=F.col("old.source") != "board3")
    return rows.select("source", "ext_id", "title", "content_hash", day("first_seen_at").alias("first_day"), day("last_seen_at").alias("last_day"), day("closed_at").alias("closed_day"))


@query(LISTING_SQL + "SELECT source, count(*) AS closed FROM diff WHERE is_stored AND NOT is_listed AND closed_at IS NULL AND source <> 'manual' GROUP BY source")
def close_missing(t: Tables) -> DataFrame:
    stored, listed = stored_and_listed(t)
    gone = stored.where("closed_at IS NULL AND source <> 'manual'").join(listed.select("source", "ext_id"), ["source", "ext_id"], "left_anti")
    return gone.groupBy("source").agg(F.count("*").alias("closed"))


@query(f"SELECT id FROM jobs WHERE source = 'manual' AND closed_at IS NULL AND last_seen_at < TIMESTAMP '{POSTING_NOW}' - INTERVAL 45 DAY")
def close_stale_manual(t: Tables) -> DataFrame:
    old = F.col("last_seen_at") < F.to_timestamp(F.lit(POSTING_NOW)) - F.expr("INTERVAL 45 DAYS")
    return t.jobs.where("source = 'manual' AND closed_at IS NULL").where(old).select("id")


@query(f"""
SELECT u.user_id, u.job_id FROM user_jobs u JOIN jobs j ON j.id = u.job_id WHERE NOT (j.closed_at < TIMESTAMP '{POSTING_NOW}' - INTERVAL 30 DAY AND u.stage <> 'scored'
  AND NOT EXISTS (SELECT 1 FROM applications a WHERE a.user_id = u.user_id AND a.job_id = u.job_id)) OR j.closed_at IS NULL""")
def prune_closed(t: Tables) -> DataFrame:
    """Outcomes that stay: those of jobs closed over 30 days ago go, unless scored or tracked."""
    old = t.jobs.where(F.col("closed_at") < F.to_timestamp(F.lit(POSTING_NOW)) - F.expr("INTERVAL 30 DAYS")).select(F.col("id").alias("job_id"))
    gone = t.user_jobs.where("stage <> 'scored'").join(old, "job_id", "left_semi").join(t.applications.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")
    return t.user_jobs.select("user_id", "job_id").join(gone.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")


@query("""
, old AS (SELECT user_id, kind, count(*) AS uses, max(id) AS last_id FROM usage WHERE id % 2 = 0 GROUP BY ALL), new AS (SELECT user_id, kind, max(id) AS last_id FROM usage WHERE id % 2 = 1 GROUP BY ALL)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.kind, n.kind) AS kind, CASE WHEN o.user_id IS NULL THEN 1 WHEN n.user_id IS NULL THEN o.uses ELSE o.uses + 1 END AS uses, coalesce(n.last_id, o.last_id) AS last_id
FROM old o FULL JOIN new n ON o.user_id = n.user_id AND o.kind = n.kind""")
def upsert_counter(t: Tables) -> DataFrame:
    """An answer bank: a saved answer replaces the old one and counts one use more."""
    old = t.usage.where("id % 2 = 0").groupBy("user_id", "kind").agg(F.count("*").alias("uses"), F.max("id").alias("last_id"))
    new = t.usage.where("id % 2 = 1").groupBy("user_id", "kind").agg(F.lit(1).cast("long").alias("uses"), F.max("id").alias("last_id"))
    return upsert(old, new, ["user_id", "kind"], {"uses": F.col("old.uses") + 1})


@query("""
SELECT user_id, job_id, spent_before FROM (
  SELECT user_id, id AS job_id, coalesce(sum(cost_cents) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM usage
) WHERE spent_before < 20000""")
def budget_order_cut(t: Tables) -> DataFrame:
    cut = budget_cut(t.usage, ["user_id"], "cost_cents", 20000, F.asc("id"))
    return cut.select("user_id", F.col("id").alias("job_id"), "spent_before")


@query(f"""
, seen AS (SELECT user_id, max(created_at) AS last_at, count(*) FILTER (created_at > TIMESTAMP '{EVENT_NOW}' - INTERVAL 1 DAY) AS today FROM usage GROUP BY user_id)
SELECT user_id, CASE WHEN last_at < TIMESTAMP '{EVENT_NOW}' - INTERVAL 14 DAY THEN 0 WHEN today >= 100 THEN 0 ELSE least(30, 100 - today) END AS allowed FROM seen""")
def score_limit(t: Tables) -> DataFrame:
    """How many jobs a run may score: none for inactive users, else what is left of the day, at most 30."""
    now = F.to_timestamp(F.lit(EVENT_NOW))
    seen = t.usage.groupBy("user_id").agg(F.max("created_at").alias("last_at"), F.count(F.when(F.col("created_at") > now - F.expr("INTERVAL 1 DAY"), 1)).alias("today"))
    allowed = F.when(F.col("last_at") < now - F.expr("INTERVAL 14 DAYS"), 0).when(F.col("today") >= 100, 0).otherwise(F.least(F.lit(30), 100 - F.col("today")))
    return seen.select("user_id", allowed.cast("long").alias("allowed"))


@query("""
SELECT user_id, least(user_left, global_left, 500) AS allowance, CASE WHEN least(user_left, global_left, 500) = 500 THEN 'per_run' WHEN user_left <= global_left THEN 'user' ELSE 'global' END AS bound_by
FROM (SELECT user_id, greatest(0, 600 - sum(cost_cents) // 100)::BIGINT AS user_left, greatest(0, 40000 - (SELECT sum(cost_cents) // 100 FROM usage))::BIGINT AS global_left FROM usage GROUP BY user_id)""")
def allowance(t: Tables) -> DataFrame:
    """What a run may spend for a user, and which limit binds."""
    total = t.usage.agg(F.greatest(F.lit(0), 40000 - F.floor(F.sum("cost_cents") / 100))).scalar()
    rows = t.usage.groupBy("user_id").agg(F.greatest(F.lit(0), 600 - F.floor(F.sum("cost_cents") / 100)).alias("user_left")).withColumn("global_left", total)
    value = F.least("user_left", "global_left", F.lit(500))
    bound = F.when(value == 500, "per_run").when(F.col("user_left") <= F.col("global_left"), "user").otherwise("global")
    return rows.select("user_id", value.alias("allowance"), bound.alias("bound_by"))


@query("""
SELECT user_id, sum(CASE WHEN gap THEN 1 ELSE 0 END)::BIGINT AS sessions FROM (
  SELECT user_id, coalesce(created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, id) > INTERVAL 30 MINUTE, true) AS gap FROM usage
) GROUP BY user_id""")
def activity_sessions(t: Tables) -> DataFrame:
    """An extra beyond the posting queries: visits of each user, parted by half an hour without events."""
    order, micros = Window.partitionBy("user_id").orderBy("created_at", "id"), F.unix_micros(F.col("created_at").cast("timestamp"))
    gap = F.coalesce(micros - F.lag(micros).over(order) > 1_800_000_000, F.lit(True))
    return t.usage.withColumn("gap", gap).groupBy("user_id").agg(F.sum(F.col("gap").cast("long")).alias("sessions"))
