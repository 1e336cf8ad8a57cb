"""Changes of users' own tables: applications, profiles, boards, outgoing mail. Each gives the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import manual_hash
from gleaner.operators.merge import upsert

#: Attempts after which a message is given up, and minutes that a claimed one may stay unsent.
ATTEMPTS, CLAIM_MINUTES = 5, 10


def put_applications(applications: DataFrame, asked: DataFrame, matches: DataFrame, now: Column) -> DataFrame:
    """``applications`` (user_id, job_id, status, notes, applied_at, updated_at) after ``asked`` (user_id, job_id, status, notes).

    Only jobs that the user has a match for are taken. Null notes keep what there was; applied_at is set by the change
    into ``applied`` alone.
    """
    keys = ["user_id", "job_id"]
    staged = asked.join(matches.select(*keys).distinct(), keys, "left_semi")
    staged = staged.select(*keys, "status", "notes", F.when(F.col("status") == "applied", now).alias("applied_at"), now.alias("updated_at"))
    into = (F.col("old.status") != "applied") & (F.col("new.status") == "applied")
    values = {"notes": F.coalesce("new.notes", "old.notes"), "applied_at": F.when(into, now).otherwise(F.col("old.applied_at"))}
    after = upsert(applications, staged, keys, values)
    return after.withColumn("notes", F.coalesce("notes", F.lit("")))


def saved_profile(matches: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Users' ``matches`` (user_id, stage, content_hash, ...) once profiles (user_id, profile_hash, preferences) have changed.

    New preferences void the rule outcome (content_hash becomes null); a new text alone sends scored rows back to be
    scored again.
    """
    old = before.select("user_id", F.col("profile_hash").alias("_hash"), F.col("preferences").alias("_prefs"))
    rules = ~F.col("preferences").eqNullSafe(F.col("_prefs"))
    text = ~F.col("profile_hash").eqNullSafe(F.col("_hash"))
    changed = after.join(old, "user_id", "left").select("user_id", rules.alias("_rules"), (text & ~rules).alias("_text"))
    joined = matches.join(changed, "user_id", "left")
    stage = F.when(F.col("_text") & F.col("stage").isin("scored", "score_failed"), "pending_score").otherwise(F.col("stage"))
    digest = F.when(F.col("_rules"), None).otherwise(F.col("content_hash"))
    return joined.withColumns({"stage": stage, "content_hash": digest}).select(*matches.columns)


def reconciled_boards(companies: DataFrame, listed: DataFrame) -> DataFrame:
    """``companies`` (id, name, ats, token, enabled) with moved_to, once ``listed`` (ats, token, name) says who has each board.

    A board listed under a new name gives its row that name. Where the name is taken by another row, that row gets the
    jobs (moved_to) and the old one lets go of its board. All names are compared as they stood before.
    """
    wanted = listed.select("ats", "token", F.col("name").alias("_name")).dropDuplicates(["ats", "token"])
    taken = companies.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("_owner"))
    joined = companies.join(wanted.join(taken, "_name", "left"), ["ats", "token"], "left")
    other = F.col("_name").isNotNull() & (F.col("_name") != F.col("name"))
    gone = other & F.col("_owner").isNotNull()
    new = {
        "name": F.when(other & ~gone, F.col("_name")).otherwise(F.col("name")),
        "ats": F.when(gone, "manual").otherwise(F.col("ats")),
        "token": F.when(gone, F.concat(F.lit("manual:"), F.col("id").cast("string"))).otherwise(F.col("token")),
        "enabled": F.col("enabled") & ~gone,
        "moved_to": F.when(gone, F.col("_owner")),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in [*companies.columns, "moved_to"]])


def watched_boards(companies: DataFrame, asked: DataFrame) -> DataFrame:
    """``companies`` once users ask to watch the boards (company_id, ats, token) that their jobs came from.

    Only a manual company takes a board, and only one that no company has yet, whatever the case of its token.
    """
    known = companies.select(F.col("ats"), F.lower("token").alias("_token")).distinct()
    free = asked.withColumn("_token", F.lower("token")).join(known, ["ats", "_token"], "left_anti")
    first = Window.partitionBy("company_id").orderBy("ats", "token")
    own = free.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("company_id").alias("id"), F.col("ats").alias("_ats"), F.col("token").alias("_new"))
    joined = companies.join(own, "id", "left")
    take = F.col("_ats").isNotNull() & (F.col("ats") == "manual")
    new = {"ats": F.when(take, F.col("_ats")).otherwise(F.col("ats")), "token": F.when(take, F.col("_new")).otherwise(F.col("token")), "enabled": F.col("enabled") | take}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in companies.columns])


def claimed(mail: DataFrame, now: Column, most: int) -> DataFrame:
    """The up to ``most`` messages (id, status, attempts, next_attempt_at) that are due longest, as claimed for sending."""
    due = mail.where(F.col("status").isin("queued", "sending") & (F.col("next_attempt_at") <= now))
    later = now + F.make_dt_interval(mins=F.lit(CLAIM_MINUTES))
    return due.orderBy("next_attempt_at", "id").limit(most).withColumns({"status": F.lit("sending"), "attempts": F.col("attempts") + 1, "next_attempt_at": later})


def after_failure(mail: DataFrame, now: Column) -> DataFrame:
    """Messages (attempts, status, next_attempt_at) after a failed attempt: again in 1, 4, 16, 64 minutes, then never."""
    over = F.col("attempts") >= ATTEMPTS
    wait = F.make_dt_interval(mins=F.pow(F.lit(4), F.least(F.col("attempts"), F.lit(ATTEMPTS)) - 1).cast("int"))
    return mail.withColumns({"status": F.when(over, "failed").otherwise("queued"), "next_attempt_at": F.when(over, F.col("next_attempt_at")).otherwise(now + wait)})


def touched(users: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """``users`` (id, last_seen_at) with ``now`` for those of ``seen`` (id) who were last seen over an hour ago, or never."""
    joined = users.join(seen.select("id").distinct().withColumn("_seen", F.lit(True)), "id", "left")
    old = F.col("last_seen_at").isNull() | (F.col("last_seen_at") < now - F.make_dt_interval(hours=F.lit(1)))
    return joined.withColumn("last_seen_at", F.when(F.col("_seen") & old, now).otherwise(F.col("last_seen_at"))).select(*users.columns)


def requeued(matches: DataFrame, analyses: DataFrame, profile_hash: str = "profile_hash") -> DataFrame:
    """``matches`` in which a scored row without an analysis for the user's current profile waits to be scored again.

    ``analyses``: rows (user_id, job_id) that are current.
    """
    current = analyses.select("user_id", "job_id").distinct().withColumn("_current", F.lit(True))
    joined = matches.join(current, ["user_id", "job_id"], "left")
    stage = F.when((F.col("stage") == "scored") & F.col("_current").isNull(), "pending_score").otherwise(F.col("stage"))
    return joined.withColumn("stage", stage).select(*matches.columns)


def answered(questions: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Attempts (user_id, question_id, choice, correct, answer, explanation, created_at) from choices of 0 to 3 on known ``questions`` (id, answer, explanation)."""
    own = questions.select(F.col("id").alias("question_id"), "answer", "explanation")
    graded = asked.where(F.col("choice").between(0, 3)).join(own, "question_id")
    return graded.select("user_id", "question_id", "choice", (F.col("choice") == F.col("answer")).alias("correct"), "answer", "explanation", now.alias("created_at"))


def run_log(runs: DataFrame, finished: DataFrame, now: Column) -> DataFrame:
    """``runs`` (id, started_at, finished_at, status, error, totals...) with the totals and the end of those in ``finished`` (id, status, error, totals...)."""
    given = [c for c in finished.columns if c not in ("id", "error")]
    closing = finished.select("id", *given, F.nullif("error", F.lit("")).alias("error"), now.alias("finished_at"))
    return upsert(runs, closing.join(runs.select("id"), "id", "left_semi"), ["id"])


def saved_resumes(resumes: DataFrame, saved: DataFrame) -> DataFrame:
    """``resumes`` (user_id, job_id, ...) with the newest of ``saved`` (..., updated_at) for each user and job.

    A user has one resume for each job and one base resume, whose job_id is null: null keys match each other.
    """
    newest = Window.partitionBy("user_id", "job_id").orderBy(F.desc("updated_at"))
    latest = saved.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return upsert(resumes, latest, ["user_id", "job_id"])


def autofill_runs(pages: DataFrame) -> DataFrame:
    """Rows (run_id, user_id, pages, fields, filled, cost_cents) from the pages (run_id, user_id, fields, filled, cost_cents) that a form was filled on."""
    return pages.groupBy("run_id", "user_id").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("fields", "filled", "cost_cents")])


def added_jobs(jobs: DataFrame, matches: DataFrame, companies: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (user_id, url, job_id, is_new, company_id, company, ext_id, content_hash): what a posting that a user adds by hand becomes.

    ``asked``: (user_id, url, title, location, description, company); ``found``: (user_id, url, job_id), the user's own
    postings by address. The ladder: the user's own posting; else an open one of the same address that any user has,
    board postings before manual ones, then the smallest id; else a new one, under the company of that name whatever
    its case, boards first, or a new manual company (company_id null). New postings of a user are named by user and
    address, so adding one twice gives one.
    """
    plain = lambda c: F.rtrim(c, F.lit("/"))
    rank = F.struct((F.col("source") == "manual").alias("manual"), F.col("id").alias("id"))
    shared = jobs.where("closed_at IS NULL").groupBy(plain(F.col("url")).alias("_address")).agg(F.min(rank)["id"].alias("_shared"))
    named = companies.groupBy(F.lower("name").alias("_name")).agg(F.min(F.struct((F.col("ats") == "manual").alias("manual"), "id"))["id"].alias("company_id"))
    rows = asked.join(found.select("user_id", "url", F.col("job_id").alias("_own")), ["user_id", "url"], "left").withColumns({"_address": plain(F.col("url")), "_name": F.lower("company")})
    rows = rows.join(shared, "_address", "left").join(named, "_name", "left")
    known = F.coalesce("_own", "_shared")
    fresh = lambda c: F.when(known.isNull(), c)
    ext_id = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.left(F.sha2("url", 256), F.lit(16)))
    digest = manual_hash(F.col("title"), F.col("location"), F.col("description"))
    return rows.select("user_id", "url", known.alias("job_id"), known.isNull().alias("is_new"), fresh(F.col("company_id")).alias("company_id"), fresh(F.col("company")).alias("company"), fresh(ext_id).alias("ext_id"), fresh(digest).alias("content_hash"))
