"""Reviews of resumes made of whole documents (an entry a line, a bullet a sentence), similar titles, and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import resumes as P
from gleaner.functions import review as V
from gleaner.functions import text as X
from gleaner.operators.setjoin import similar_sets
from gleaner.plans.tables import Tables
from gleaner.queries.register import registry

QUERIES, ORACLES, query = registry()

#: What stands in front of bullets, in turn, so that rules on openings and wording meet every document.
OPENINGS = ["", "Responsible for ", "", "I led 3 teams: ", "Built ", "", "A passionate team player who ", "Built "]
TITLES = ["Experience", "Skills", "My Journey", "education", "Projects", "Professional Experience"]
KINDS = ["entries", "skills", "entries", "entries", "projects", "summary"]
DATES = ["Jan 2020 - Mar 2021", "", "2020-01", "January 2020", "01/2020", "2020"]
SECTIONS = 4


def resumes(t: Tables) -> DataFrame:
    """Rows (doc_id, resume, pages): every line of a document is an entry of one of four sections, every sentence a bullet."""
    key, of = F.col("doc_id").cast("int"), lambda values, i: F.get(F.array(*map(F.lit, values)), i % len(values))
    rows = t.raw("documents").select("doc_id", "lang", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))

    def bullet(s, i, line):
        text = F.concat(of(OPENINGS, i + line + key), s, F.when((i + key) % 3 == 0, ".").otherwise(""))
        return F.struct(F.concat_ws(".", F.lit("b"), line, i).alias("id"), text.alias("text"), ((i + line) % 9 == 8).alias("hidden"))

    def entry(line, i):
        bullets = F.filter(F.split(line, r"\. ?", -1), lambda s: s != "")
        return F.struct(
            F.concat(F.lit("e"), i.cast("string")).alias("id"), F.substring_index(line, " ", 1).alias("heading"), F.when(i % 2 == 0, "Lead").alias("subheading"), of(DATES, i + key).alias("dates"), F.lit(None).cast("string").alias("location"),
            F.when(i % 3 == 0, "Go").alias("tech"), F.when(i % 4 == 1, line).alias("text"), F.transform(bullets, lambda s, j: bullet(s, j, i)).alias("bullets"), (i % 7 == 6).alias("hidden"),
        )

    entries = rows.select("doc_id", "lang", F.transform("lines", entry).alias("entries"), F.get("lines", F.lit(0)).alias("first"))

    def section(k):
        mine = F.filter("entries", lambda e, i: i % SECTIONS == k)
        skills = F.when(key % 2 == 0, F.array(F.struct(F.lit("g").alias("id"), F.lit("Tools").alias("name"), F.replace("first", F.lit(" "), F.lit(", ")).alias("items"))))
        return F.struct(F.concat(F.lit("s"), F.lit(str(k))).alias("id"), of(KINDS, key + k).alias("kind"), of(TITLES, key + k).alias("title"), ((key + k) % 11 == 10).alias("hidden"), mine.alias("entries"), skills.alias("skills"), F.when(F.lit(k == 1), F.col("first")).alias("text"))

    made = F.struct(
        F.concat(F.lit("Name "), key.cast("string")).alias("name"), F.when(key % 2 == 0, "Engineer").alias("headline"), F.when(key % 3 > 0, "+1 555").alias("phone"), F.when(key % 4 > 0, "a@b.example").alias("email"), F.col("lang").alias("location"),
        F.when(key % 5 > 0, F.array(F.struct(F.lit("me").alias("label"), F.when(key % 5 > 2, "https://GitHub.com/me").otherwise("https://x.example").alias("url")))).alias("links"), F.array(*[section(k) for k in range(SECTIONS)]).alias("sections"),
    )
    return entries.select("doc_id", made.cast(V.RESUME).alias("resume"), F.when(key % 6 > 0, key % 3).alias("pages"))


@query()
def resume_reviews(t: Tables) -> DataFrame:
    """Score, findings in order and the text of every resume."""
    judged = resumes(t).select("doc_id", V.review(F.col("resume"), F.col("pages")).alias("r"), V.plain_text(F.col("resume")).alias("text"))
    findings = F.transform("r.checks", lambda c: F.concat_ws("|", c["id"], c["severity"], c["target"], c["message"]))
    return judged.select("doc_id", "r.score", F.size("r.checks").alias("n"), F.sha2(F.array_join(findings, "\n"), 256).alias("findings_sha256"), F.sha2("text", 256).alias("text_sha256"))


@query(with_tables=False, sql=r"""
WITH titles AS (SELECT doc_id AS k, lower(array_to_string(string_split(text, ' ')[1:5], ' ')) AS title FROM documents UNION ALL SELECT 10000000 + p_partkey, lower(p_name) FROM part),
words AS (SELECT DISTINCT k, unnest(regexp_split_to_array(title, '[^a-z0-9]+')) AS word FROM titles),
grams AS (SELECT DISTINCT k, substr('  ' || word || ' ', i, 3) AS g FROM (SELECT k, word, unnest(range(1, len(word) + 2)) AS i FROM words WHERE word <> '')),
whole AS (SELECT k, list(g ORDER BY g) AS e FROM grams GROUP BY k), members AS (SELECT e, min(k) AS id FROM whole GROUP BY e),
named AS (SELECT id, unnest(e) AS g, len(e) AS n FROM members),
shared AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM named x JOIN named y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id)
SELECT a, b, round(c / (na + nb - c)::DOUBLE, 9) AS similarity FROM shared WHERE c / (na + nb - c)::DOUBLE >= 0.35
UNION ALL SELECT id, k, 1.0 FROM whole JOIN members USING (e) WHERE k <> id""")
def similar_title_pairs(t: Tables) -> DataFrame:
    """Titles of all documents (their first five words) and all part names that are similar by their three-letter pieces."""
    docs = t.raw("documents").select(F.col("doc_id").alias("k"), F.substring_index("text", " ", 5).alias("title"))
    parts = t.raw("part").select((F.lit(10_000_000) + F.col("p_partkey")).alias("k"), F.col("p_name").alias("title"))
    titles = docs.unionByName(parts).select("k", F.lower(F.coalesce("title", F.lit(""))).alias("title"))
    return similar_sets(titles, "k", "title", 0.35, of=X.trigrams).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(r"""
WITH stored AS (
  SELECT c_custkey AS user_id, c_custkey % 13 = 12 AS none, '{"gender":"' || CASE c_custkey % 3 WHEN 0 THEN 'decline' WHEN 1 THEN 'woman' ELSE '' END || '","name":"' || c_name || '","more":{"segment":"' || c_mktsegment || '","list":[1,2]},"veteran":"'
    || CASE WHEN c_custkey % 2 = 0 THEN 'decline' ELSE 'no' END || '"}' AS details FROM customer)
, patched AS (SELECT user_id, none, json_merge_patch(json_merge_patch(details, CASE WHEN details->>'gender' = 'decline' THEN '{"gender":""}' ELSE '{}' END), CASE WHEN details->>'veteran' = 'decline' THEN '{"veteran":""}' ELSE '{}' END) AS d FROM stored)
SELECT user_id, CASE WHEN NOT none THEN d->>'gender' END AS gender, CASE WHEN NOT none THEN d->>'veteran' END AS veteran, CASE WHEN NOT none THEN d->>'name' END AS name, CASE WHEN NOT none THEN d->'more'->>'segment' END AS segment FROM patched""", with_tables=False)
def cleared_defaults(t: Tables) -> DataFrame:
    """Stored details of all customers without answers that were only a default; what else they hold stays."""
    key = F.col("c_custkey")
    gender = F.when(key % 3 == 0, "decline").when(key % 3 == 1, "woman").otherwise("")
    pieces = (F.lit('{"gender":"'), gender, F.lit('","name":"'), "c_name", F.lit('","more":{"segment":"'), "c_mktsegment", F.lit('","list":[1,2]},"veteran":"'), F.when(key % 2 == 0, "decline").otherwise("no"), F.lit('"}'))
    stored = t.raw("customer").select(key.alias("user_id"), F.when(key % 13 != 12, F.concat(*pieces)).alias("details"))
    rows = stored.select("user_id", P.without_stored_defaults(F.col("details")).alias("d"))
    fields = {"gender": "gender", "veteran": "veteran", "name": "name", "segment": "more.segment"}
    return rows.select("user_id", *[F.get_json_object("d", f"$.{path}").alias(c) for c, path in fields.items()])
