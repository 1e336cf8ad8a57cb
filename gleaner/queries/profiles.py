"""Profiles, resumes, forms, board pages and the postings they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import phrases, replies
from gleaner.functions import resumes as P
from gleaner.operators import accounts, lookup
from gleaner.operators.joins import spread
from gleaner.plans.tables import Tables
from gleaner.queries.content import CATALOG, PREFS, RULE_SQL, rule_postings
from gleaner.queries.register import registry

QUERIES, ORACLES, query = registry()


@query(r"""
SELECT l_orderkey * 10 + l_linenumber AS id, CASE k WHEN 3 THEN strftime(l_shipdate, '%Y') WHEN 4 THEN strftime(l_shipdate, '%Y') || '-06' WHEN 6 THEN '' ELSE strftime(l_shipdate, '%Y-%m') END AS start,
  CASE k WHEN 0 THEN strftime(l_receiptdate, '%Y-%m') WHEN 2 THEN strftime(l_receiptdate, '%Y-%m') WHEN 3 THEN strftime(l_receiptdate, '%Y') ELSE '' END AS "end", k IN (1, 6) AS current
FROM (SELECT *, l_shipdate + INTERVAL 40 DAY AS l_receiptdate, l_linenumber % 7 AS k FROM lineitem)""", with_tables=False)
def resume_dates(t: Tables) -> DataFrame:
    """Ranges of dates written in seven ways, read back."""
    ship, end, k = F.col("l_shipdate"), F.date_add(F.to_date("l_shipdate"), 40), F.col("l_linenumber") % 7
    said = lambda form, d: F.date_format(d, form)
    text = (
        F.when(k == 0, F.concat(said("MMM yyyy", ship), F.lit(" – "), said("MMMM yyyy", end)))
        .when(k == 1, F.concat(said("MM/yyyy", ship), F.lit(" to Present")))
        .when(k == 2, F.concat(said("yyyy-MM", ship), F.lit(" - "), said("M / yyyy", end)))
        .when(k == 3, F.concat(said("yyyy", ship), F.lit(" – "), said("yyyy", end)))
        .when(k == 4, F.concat(F.lit("Summer "), said("yyyy", ship)))
        .when(k == 5, F.concat(F.lit("Expected "), said("MMM. yyyy", ship)))
        .otherwise("ongoing")
    )
    dates = P.parsed_dates(text)
    return t.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), dates.alias("d")).select("id", "d.start", "d.end", "d.current")


@query(r"""
SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber <> 6 AND CASE k WHEN 0 THEN d < DATE '1996-02-10' WHEN 1 THEN d < DATE '1996-02-10' WHEN 2 THEN date_trunc('month', d) + INTERVAL 1 MONTH <= DATE '1996-02-10' WHEN 3 THEN year(d) < 1996 ELSE false END AS past
FROM (SELECT *, CAST(l_shipdate AS DATE) AS d, l_linenumber % 5 AS k FROM lineitem)""", with_tables=False)
def past_starts(t: Tables) -> DataFrame:
    """Answers to a form's question for a start, in five forms, on one day."""
    ship, k = F.col("l_shipdate"), F.col("l_linenumber") % 5
    value = F.when(k == 0, F.date_format(ship, "yyyy-MM-dd")).when(k == 1, F.date_format(ship, "M/d/yyyy")).when(k == 2, F.date_format(ship, "yyyy-M")).when(k == 3, F.concat(F.lit("early "), F.date_format(ship, "yyyy"))).otherwise("soon")
    label = F.when(F.col("l_linenumber") == 6, "Salary").otherwise("When can you START?")
    return t.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), P.past_start(label, value, F.lit("1996-02-10").cast("date")).alias("past"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' only' ELSE '## Skills' || chr(10) || p_type || chr(10) || chr(10) || '## Licenses and more' || chr(10) || p_brand END AS kept FROM part", with_tables=False)
def profile_text(t: Tables) -> DataFrame:
    """What is used of a profile for matching."""
    parts = ("intro\n## History\n", "p_name", "\n## Skills\n", "p_type", "\n\n\n## Other\nx\n## Licenses and more\n", "p_brand", "\n")
    whole = F.concat(*[F.col(p) if p.startswith("p_") else F.lit(p) for p in parts])
    markdown = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" only"))).otherwise(whole)
    return t.raw("part").select("p_partkey", P.profile_sections(markdown).alias("kept"))


@query("SELECT p_partkey, p_name || '. Seniority: ' || p_brand || '. Skills: ' || array_to_string(string_split(p_type, ' '), ', ') || '. ' || p_name AS body FROM part", with_tables=False)
def embedded_text(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", P.document_text(F.col("p_name"), F.col("p_brand"), F.split("p_type", " "), F.col("p_name")).alias("body"))


@query(r"""
, cleaned AS (SELECT doc_id, trim(text, w) AS s, w FROM documents, (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS w))
, cut AS (SELECT doc_id, CASE WHEN strpos(s, '. ') > 1 THEN left(s, strpos(s, '. ')) ELSE s END AS s FROM cleaned)
SELECT doc_id, strlen(s) <= 90 AS whole, CASE WHEN strlen(s) <= 90 THEN s END AS sentence FROM cut""")
def first_sentences(t: Tables) -> DataFrame:
    """First sentences that fit whole; the tests hold the cut ones against a plain version."""
    rows = t.raw("documents").select("doc_id", P.first_sentence(F.col("text"), 90).alias("s"))
    whole = ~F.col("s").endswith("…")
    return rows.select("doc_id", whole.alias("whole"), F.when(whole, F.col("s")).alias("sentence"))


@query(r"""
, lines AS (SELECT doc_id, list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda l: trim(regexp_replace(l, '[ \t\f\v]+', ' ', 'g'), ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS l FROM documents)
SELECT doc_id, left(trim(regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)), 30000) AS text FROM lines""")
def cleaned_text(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", P.clean_text(F.col("text")).alias("text"))


@query("SELECT p_partkey, concat_ws(',', 'spark', 'c++', CASE WHEN p_partkey % 2 = 0 THEN 'go' END, 'machine learning', 'kubernetes') AS terms FROM part", with_tables=False)
def term_hits(t: Tables) -> DataFrame:
    """Known skills in texts that name them among the words of the table."""
    even = F.when(F.col("p_partkey") % 2 == 0, " go,").otherwise(",")
    text = F.concat(F.lit("Spark and C++ with "), "p_name", even, F.lit(" machine learning ("), "p_type", F.lit("), kubernetes, k8s"))
    return spread(t.raw("part"), "p_partkey").select("p_partkey", F.array_join(P.known_terms(text), ",").alias("terms"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_type END AS picked FROM part", with_tables=False)
def form_choices(t: Tables) -> DataFrame:
    """A form's option that an answer names."""
    value = F.when(F.col("p_partkey") % 4 == 3, "none of them").otherwise(F.concat(F.lit("  "), F.lower("p_type"), F.lit("\t")))
    return t.raw("part").select("p_partkey", P.choice(F.array(F.lit("Other"), "p_type", F.lit("x")), value).alias("picked"))


@query(r"""
SELECT c_custkey, 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '/Of-The' AS name, '"' || 'a\"b' || CAST(c_custkey AS VARCHAR) || '"' AS quoted, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS one_page,
  CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'weekly' END AS setting, 'k=' || c_mktsegment AS details FROM customer""", with_tables=False)
def stored_json(t: Tables) -> DataFrame:
    """JSON columns: text as JSON, flags, settings with defaults, filled details; and the capitals of a stored name."""
    key = F.col("c_custkey")
    flag = F.when(key % 3 == 0, '{"a": true}').when(key % 3 == 1, '{"a": false}').otherwise('{"b": 1}')
    filled = F.to_json(F.create_map(F.lit("k"), "c_mktsegment", F.lit("empty"), F.lit(" ")))
    return t.raw("customer").select(
        "c_custkey",
        P.capitalized(F.concat(F.lower("c_name"), F.lit("/of-the"))).alias("name"),
        P.json_text(F.concat(F.lit('a"b'), key.cast("string"))).alias("quoted"),
        P.json_flag(flag, "$.a").alias("one_page"),
        P.json_setting(flag, "$.a", "weekly").alias("setting"),
        F.array_join(F.transform(P.json_details(filled), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("details"),
    )


@query("""
, openly AS (SELECT j.id, CAST(100000 + id AS VARCHAR) AS ext FROM jobs j WHERE id % 50 > 0)
SELECT id AS page_id, CASE WHEN id % 5 IN (0, 1, 2, 3) THEN id END AS job_id FROM openly""")
def jobs_by_url(t: Tables) -> DataFrame:
    """The posting behind each page: its address, its application form, a board parameter, an id at the end; or none."""
    rows = t.jobs.where("id % 50 > 0").select("id", "closed_at")
    ext = (100000 + F.col("id")).cast("string")
    jobs = rows.select("id", F.concat(F.lit("https://boards.example/p/"), ext).alias("url"), F.lit("greenhouse").alias("source"), ext.alias("ext_id"), "closed_at")
    k = F.col("id") % 5
    url = (
        F.when(k == 0, F.concat(F.lit("https://boards.example/p/"), ext, F.lit("/?utm_source=x")))
        .when(k == 1, F.concat(F.lit("https://boards.example/p/"), ext, F.lit("/apply/now")))
        .when(k == 2, F.concat(F.lit("https://own.example/careers?gh_jid="), ext))
        .when(k == 3, F.concat(F.lit("https://forms.example/x/"), ext, F.lit("/application")))
        .otherwise("https://own.example/careers")
    )
    pages = rows.select(F.col("id").alias("page_id"), F.lit(1).alias("user_id"), url.alias("url"))
    found = lookup.found_by_url(pages, jobs, rows.select(F.lit(1).alias("user_id"), F.col("id").alias("job_id")))
    return pages.select("page_id").join(found.select("page_id", "job_id"), "page_id", "left")


@query("""
, listed AS (SELECT source AS board, id AS ext_id, (row_number() OVER (PARTITION BY source ORDER BY first_seen_at DESC, id) - 1) // 20 AS page, first_seen_at < DATE '1998-01-01' OR source = 'board3' AS known FROM jobs)
, fresh AS (SELECT board, page, count(*) FILTER (NOT known) AS n FROM listed GROUP BY ALL)
, stops AS (SELECT board, min(page) FILTER (n = 0) AS stop, max(page) AS last FROM fresh GROUP BY board)
SELECT board, ext_id, stop IS NULL OR stop = last AS complete FROM listed JOIN stops USING (board) WHERE stop IS NULL OR page <= stop""")
def newest_listings(t: Tables) -> DataFrame:
    """Newest-first pages of every board, read up to the first page that holds nothing new."""
    order = Window.partitionBy("source").orderBy(F.desc("first_seen_at"), "id")
    listed = t.jobs.select(F.col("source").alias("board"), F.col("id").alias("ext_id"), F.floor((F.row_number().over(order) - 1) / 20).alias("page"), "first_seen_at")
    known = listed.where((F.col("first_seen_at") < F.lit("1998-01-01").cast("timestamp")) | (F.col("board") == "board3")).select("board", "ext_id")
    return lookup.newest_pages(listed, known).select("board", "ext_id", "complete")


@query("SELECT id AS board, id % 7 AS etag FROM companies WHERE id % 3 <> 1 OR id % 7 = 0", with_tables=True)
def modified_boards(t: Tables) -> DataFrame:
    """Boards whose pages carry another tag than the stored one, or that have none stored."""
    pages = t.companies.select(F.col("id").alias("board"), (F.col("id") % 7).alias("etag"))
    stored = t.companies.where("id % 3 <> 0").select(F.col("id").alias("board"), F.when(F.col("id") % 3 == 1, F.nullif(F.col("id") % 7, F.lit(0))).otherwise(F.col("id") % 7 + 1).alias("etag"))
    return lookup.modified(pages, stored)


@query(RULE_SQL + """
SELECT id, CASE WHEN id % 4 = 0 THEN 'kept from before' ELSE coalesce(reason, 'kept') END AS reason, CASE WHEN id % 4 IN (0, 1) THEN id * 7 END AS analysis_id, id % 9 AS version FROM judged""")
def incremental_filter(t: Tables) -> DataFrame:
    """Outcomes of a user after a pass over what has none or an old one; links to analyses stay."""
    postings = rule_postings(t).select("*", (F.col("id") % 9).alias("version"), F.lit("").alias("description"))
    before = postings.where("id % 4 < 2").select(
        "id", F.when(F.col("id") % 4 == 0, F.col("version")).otherwise(F.lit(-1)).alias("version"), F.lit("kept from before").alias("reason"), (F.col("id") * 7).alias("analysis_id")
    )
    after = lookup.filtered(postings, before, PREFS, CATALOG, "version")
    return after.select("id", F.coalesce("reason", F.lit("kept")).alias("reason"), "analysis_id", "version")


@query(r"""
SELECT id, id % 6 > 0 AS valid, CASE WHEN id % 6 > 0 THEN CASE id % 6 WHEN 1 THEN 75 ELSE 80 END END AS fit, CASE WHEN id % 6 > 0 THEN CASE id % 6 WHEN 1 THEN 'good' ELSE 'strong' END END AS verdict FROM posts WHERE id % 6 < 3""")
def analysis_replies(t: Tables) -> DataFrame:
    """Strict readings of made-up analyses: one with an unknown level, one with few skills matched, one without enough skills to count."""
    good = '{"ratings": {"role": 8, "seniority": 8, "skills": 8, "domain": 8, "location": 8}, "seniority": "mid", "sponsorship": "no", "work_mode": "remote", "skills_matched": %s, "skills_missing": %s}'
    key = F.col("id") % 6
    said = F.when(key == 0, good.replace("mid", "wizard") % ("[]", "[]")).when(key == 1, "```json\n" + good % ('["a"]', '["b", "c"]') + "\n```").otherwise(good % ("[]", '["b"]'))
    return t.posts.where("id % 6 < 3").select("id", replies.analysis(said).alias("a")).select("id", F.col("a").isNotNull().alias("valid"), F.col("a.fit").alias("fit"), F.col("a.verdict").alias("verdict"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a=' || p_name || ';c=' || p_brand || ';d=yes' WHEN 1 THEN 'a=' || left(p_name, 5) ELSE '' END AS answers FROM part", with_tables=False)
def form_answers(t: Tables) -> DataFrame:
    """Suggestions for a form that fit its fields; ids, options, boxes and past dates that do not fit fall out."""
    key = F.col("p_partkey") % 3
    fields = F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), options.alias("options"), limit.alias("max_length"))
        for i, label, kind, options, limit in (
            ("a", "Name", "text", F.array().cast("array<string>"), F.when(key == 1, 5).otherwise(0)),
            ("b", "Start date", "text", F.array().cast("array<string>"), F.lit(0)),
            ("c", "Brand", "select", F.array(F.lit("None"), "p_brand"), F.lit(0)),
            ("d", "Agree", "checkbox", F.array().cast("array<string>"), F.lit(0)),
        )
    ])
    answer = lambda i, v: F.struct(F.lit(i).alias("id"), v.alias("value"), F.lit("high").alias("confidence"), F.lit("").alias("why"))
    given = F.array(
        answer("a", F.when(key < 2, F.col("p_name"))), answer("a", F.lit("again")), answer("b", F.lit("2001-01-01")), answer("c", F.when(key == 0, F.upper("p_brand")).otherwise("no such")),
        answer("d", F.when(key == 0, "true").otherwise("no")), answer("zz", F.lit("unknown")),
    )
    given = F.when(key == 2, F.filter(given, lambda a: a["id"] != "a")).otherwise(given)
    reply = F.to_json(F.struct(given.alias("answers")))
    kept = replies.form_answers(reply, fields, F.lit("2002-01-01").cast("date"), phrases.clean_letter, P.choice, P.past_start)
    return spread(t.raw("part"), "p_partkey").select("p_partkey", F.array_join(F.transform(kept, lambda a: F.concat(a["id"], F.lit("="), a["value"])), ";").alias("answers"))


@query("""
, words AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' k8s'), '[^a-z0-9+#./]+'), lambda w: w <> '') AS w FROM part)
SELECT p_partkey, CAST(100 * (1 + CAST(list_contains(w, 'steel') AS INTEGER) + CAST(list_contains(w, 'bolt') OR list_contains(w, 'red') AS INTEGER)) // 4 AS INTEGER) AS percent FROM words""")
def keyword_share(t: Tables) -> DataFrame:
    """Whole percent of four keywords that a text meets by any of their forms, whatever they are called."""
    text = F.concat_ws(" ", "p_name", "p_type", F.lit("k8s"))
    keywords = F.array(*map(F.lit, ("Kubernetes", "Steel", "fasteners (bolt/red)", "Golang", "kubernetes", "")))
    return spread(t.raw("part"), "p_partkey").select("p_partkey", phrases.keyword_coverage(text, keywords)["percent"].alias("percent"))


@query("SELECT id, title || ' ' || url AS description FROM jobs WHERE id = (SELECT min(id) FROM jobs WHERE closed_at IS NULL)")
def job_description(t: Tables) -> DataFrame:
    """The text of one posting."""
    wanted = t.jobs.where("closed_at IS NULL").agg(F.min("id")).scalar()
    return t.jobs.where(F.col("id") == wanted).select("id", F.concat_ws(" ", "title", "url").alias("description"))


@query("SELECT c_custkey AS user_id FROM customer WHERE c_comment_free <> '' AND c_mktsegment <> 'AUTOMOBILE' ORDER BY user_id".replace("c_comment_free", "c_name"), with_tables=False)
def ready_profiles(t: Tables) -> DataFrame:
    """Profiles with a text and with families and levels to match."""
    families = F.filter(F.array("c_mktsegment"), lambda s: s != "AUTOMOBILE")
    rows = t.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("markdown"), families.alias("families"), F.array(F.lit("entry")).alias("levels"))
    return rows.where((F.col("markdown") != "") & (F.size("families") > 0) & (F.size("levels") > 0)).select("user_id").orderBy("user_id")


@query("""
SELECT a.job_id AS id, a.user_id, j.title, c.name AS company, a.status = 'saved' AS one_page FROM applications a LEFT JOIN jobs j ON j.id = a.job_id LEFT JOIN companies c ON c.id = j.company_id
WHERE a.user_id = 2 ORDER BY a.status = 'saved' DESC, a.job_id DESC""")
def resume_list(t: Tables) -> DataFrame:
    """A user's resumes with the posting and company that each was made for."""
    fit = F.concat(F.lit('{"one_page": '), F.when(F.col("status") == "saved", "true").otherwise("false"), F.lit("}"))
    mine = t.applications.where("user_id = 2").select(F.col("job_id").alias("id"), "user_id", "status", P.json_flag(fit, "$.one_page").alias("one_page"))
    jobs = t.jobs.select("id", "title", "company_id")
    companies = t.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    rows = mine.join(jobs, "id", "left").join(companies, "company_id", "left")
    return rows.orderBy(F.col("one_page").desc(), F.desc("id")).select("id", "user_id", "title", "company", "one_page")


@query("""
SELECT user_id, question_id, event_id % 6 AS choice, event_id % 6 = question_id % 4 AS correct, question_id % 4 AS answer FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS question_id FROM events) WHERE event_id % 6 < 4 AND question_id % 9 > 0""", with_tables=False)
def graded_answers(t: Tables) -> DataFrame:
    """Choices on known questions, graded."""
    asked = t.attempts.select("user_id", "question_id", (F.col("id") % 6).alias("choice"))
    questions = asked.select(F.col("question_id").alias("id")).distinct().where("id % 9 > 0").select("id", (F.col("id") % 4).alias("answer"), F.lit("because").alias("explanation"))
    return accounts.answered(questions, asked, F.lit("2024-01-01").cast("timestamp")).select("user_id", "question_id", "choice", "correct", "answer")


@query("""
SELECT id, status, CASE WHEN id % 4 = 0 THEN 'done' ELSE 'running' END AS state, CASE WHEN id % 8 = 0 THEN 'boom' END AS error, CASE WHEN id % 4 = 0 THEN id * 2 ELSE 0 END AS seen FROM (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders)""", with_tables=False)
def finished_runs(t: Tables) -> DataFrame:
    """A run log in which some runs have ended, with what they saw."""
    orders = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    runs = orders.select("id", "status", F.lit("running").alias("state"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("timestamp").alias("finished_at"))
    ended = orders.where("id % 4 = 0").select("id", F.lit("done").alias("state"), F.when(F.col("id") % 8 == 0, "boom").otherwise("").alias("error"), (F.col("id") * 2).alias("seen"))
    return accounts.run_log(runs, ended, F.lit("2024-01-01").cast("timestamp")).select("id", "status", "state", "error", "seen")


@query("""
SELECT user_id, coalesce(job_id, -1) AS job_id, max(day) AS day FROM (SELECT l_suppkey AS user_id, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS job_id, strftime(max(l_shipdate), '%Y-%m-%d') AS day FROM lineitem GROUP BY ALL) GROUP BY ALL""", with_tables=False)
def kept_resumes(t: Tables) -> DataFrame:
    """The newest resume of each user and job, and of each user without a job."""
    line = t.raw("lineitem").select(F.col("l_suppkey").alias("user_id"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("job_id"), F.col("l_shipdate").alias("updated_at"), "l_orderkey")
    early = line.groupBy("user_id", "job_id").agg(F.min("updated_at").alias("updated_at"))
    late = line.groupBy("user_id", "job_id", "updated_at").agg(F.count("*").alias("n")).drop("n")
    kept = accounts.saved_resumes(early, late)
    return kept.select("user_id", F.coalesce("job_id", F.lit(-1)).alias("job_id"), F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


@query(r"""
, openly AS (SELECT id, url, source FROM jobs WHERE closed_at IS NULL)
, best AS (SELECT url, (list(id ORDER BY source = 'manual', id))[1] AS shared FROM openly GROUP BY url)
, named AS (SELECT lower(name) AS n, min(id) AS company_id FROM companies GROUP BY 1)
, asked AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'https://jobs.example/' || c_custkey % 1000 ELSE 'https://new.example/' || c_custkey END AS url, c_name AS company FROM customer)
SELECT user_id, shared AS job_id, shared IS NULL AS is_new, CASE WHEN shared IS NULL THEN company_id END AS company_id, CASE WHEN shared IS NULL THEN 'u' || user_id || '-' || left(sha256(asked.url), 16) END AS ext_id
FROM asked LEFT JOIN best ON rtrim(best.url, '/') = asked.url LEFT JOIN named ON n = lower(company)""")
def added_postings(t: Tables) -> DataFrame:
    """Postings that users add by hand: shared where there is an open one of that address, else new."""
    key = F.col("c_custkey")
    url = F.when(key % 2 == 0, F.concat(F.lit("https://jobs.example/"), (key % 1000).cast("string"))).otherwise(F.concat(F.lit("https://new.example/"), key.cast("string")))
    asked = t.raw("customer").select(key.alias("user_id"), url.alias("url"), F.lit("T").alias("title"), F.lit("L").alias("location"), F.lit("D").alias("description"), F.upper("c_name").alias("company"))
    nothing = asked.select("user_id", "url", F.lit(None).cast("long").alias("job_id")).where("false")
    return accounts.added_jobs(t.jobs, t.user_jobs, t.companies, asked, nothing).select("user_id", "job_id", "is_new", "company_id", "ext_id")
