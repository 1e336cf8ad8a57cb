"""Ranks of every user's pending postings: whole documents as postings, profiles out of the benchmark's passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import ranking as K
from gleaner.operators import relevance as R
from gleaner.plans.tables import Tables
from gleaner.queries.content import tokens_sql
from gleaner.queries.register import registry

QUERIES, ORACLES, query = registry()

#: What users accept: years at most (0 for any), levels, and whether they need sponsorship; user 6 has a profile without terms.
PREFERENCES = [(0, ["mid"], False), (3, ["entry", "mid"], True), (5, ["senior"], False), (8, [], True), (2, ["internship", "entry"], False), (6, ["management"], True), (4, ["unheard of"], False)]
SENIORITY = ("internship", "entry", "junior", "mid", "senior", "management", "lead")


def profiles(t: Tables) -> DataFrame:
    """A profile for each user: a section of skills out of their benchmark passages, and one of experience."""
    passages = t.raw("benchmark").groupBy((F.col("item_id") % 7).cast("long").alias("user_id")).agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("p"))
    skills = F.array_join(F.transform("p", lambda p: p["text"]), "\n")
    markdown = F.concat(F.lit("# Profile\n\n## Skills\n"), skills, F.lit("\n\n## Experience\n- led others"), F.when(F.col("user_id") % 2 == 0, "\n- holds a secret clearance").otherwise(""))
    levels = F.array(*[F.array(*map(F.lit, levels)).cast("array<string>") for _, levels, _ in PREFERENCES])
    user = F.col("user_id").cast("int")
    return passages.select(
        "user_id",
        F.when(user == 6, "the and of").otherwise(markdown).alias("markdown"),
        F.array(*[F.lit(y) for y, _, _ in PREFERENCES])[user].alias("max_years"),
        levels[user].alias("levels"),
        F.array(*[F.lit(s) for _, _, s in PREFERENCES])[user].alias("needs_sponsorship"),
    )


def postings(t: Tables) -> DataFrame:
    """Whole documents; their first words are the title."""
    return t.raw("documents").select(F.col("doc_id").alias("job_id"), F.array_join(F.slice(F.split("text", " ", -1), 1, 4), " ").alias("title"), F.col("text").alias("body"))


def pending(t: Tables) -> DataFrame:
    """A document waits for one user, and every third one for user 0, too, who so has far more than the others."""
    key = F.col("doc_id")
    return t.raw("documents").select(F.explode(F.array_distinct(F.when(key % 3 == 0, F.array(key % 7, F.lit(0).cast("long"))).otherwise(F.array(key % 7)))).alias("user_id"), key.alias("job_id"))


def facts(t: Tables) -> DataFrame:
    """Facts of the documents that have any: skills and a digest out of their words."""
    key, word = F.col("doc_id"), lambda i: F.get("w", i - 1)
    rows = t.raw("documents").where(key % 5 != 4).select(key, "lang", F.split("text", " ", -1).alias("w"))
    skills = F.array(word(5), F.concat_ws(" ", word(9), word(10)), F.concat(word(14), F.lit(" systems")), F.when(key % 11 == 0, "secret clearance"), F.when(key % 3 == 0, word(21)))
    return rows.select(
        key.alias("job_id"),
        F.array(*map(F.lit, SENIORITY))[(key % 7).cast("int")].alias("seniority"),
        F.filter(skills, lambda s: s.isNotNull()).alias("skills"),
        F.array_join(F.slice("w", 20, 40), " ").alias("digest"),
        F.when(key % 4 > 0, (key % 11).cast("int")).alias("years"),
        F.when(F.col("lang") == "en", "remote").otherwise("onsite").alias("work_mode"),
    )


def similar(t: Tables) -> DataFrame:
    """Cosine of a posting's vector and the user's; documents past the vectors have none."""
    vectors = t.raw("embeddings").select("vec_id", "embedding")
    users = vectors.where("vec_id < 7").select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("q"))
    return pending(t).join(vectors, F.col("job_id") == F.col("vec_id")).join(F.broadcast(users), "user_id").select("user_id", "job_id", R.cosine(F.col("embedding"), F.col("q")).alias("similarity"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else _list(v) if isinstance(v, list) else str(v) for v in values) + "]"


def _tfidf_sql(name: str, docs: str, profile: str) -> str:
    """CTEs that end in ``name`` (user_id, job_id, similarity): ``docs`` (user_id, job_id, title, body) against the column ``profile`` of wanted."""
    return f"""
, {name}_raw AS (
  SELECT job_id, unnest({tokens_sql("title")}) AS term, 3 AS f FROM (SELECT DISTINCT job_id, title FROM {docs})
  UNION ALL SELECT job_id, unnest({tokens_sql("body")}), 1 FROM (SELECT DISTINCT job_id, body FROM {docs}))
, {name}_counts AS (SELECT job_id, term, sum(f) AS f FROM {name}_raw GROUP BY ALL)
, {name}_pairs AS (SELECT user_id, d.job_id, term, f FROM {docs} d JOIN {name}_counts c ON d.job_id = c.job_id)
, {name}_df AS (SELECT user_id, term, count(*) AS df FROM {name}_pairs GROUP BY ALL)
, {name}_n AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n FROM {docs} GROUP BY user_id)
, {name}_profile AS (SELECT user_id, term, count(*) AS f FROM (SELECT user_id, unnest({tokens_sql(profile)}) AS term FROM wanted) GROUP BY ALL)
, {name}_mine AS (SELECT p.user_id, p.term, (1 + ln(f)) * ln(1 + n / (1 + coalesce(df, 0))) AS w FROM {name}_profile p JOIN {name}_n USING (user_id) LEFT JOIN {name}_df d ON d.user_id = p.user_id AND d.term = p.term)
, {name}_norm AS (SELECT user_id, sqrt(sum(w * w)) AS norm FROM {name}_mine GROUP BY user_id)
, {name}_theirs AS (SELECT p.user_id, job_id, p.term, (1 + ln(f)) * ln(1 + n / (1 + df)) AS w FROM {name}_pairs p JOIN {name}_df d ON d.user_id = p.user_id AND d.term = p.term JOIN {name}_n n ON n.user_id = p.user_id)
, {name}_sums AS (SELECT t.user_id, job_id, sum(t.w * coalesce(m.w, 0)) AS dot, sqrt(sum(t.w * t.w)) AS norm FROM {name}_theirs t LEFT JOIN {name}_mine m ON m.user_id = t.user_id AND m.term = t.term GROUP BY ALL)
, {name} AS (SELECT d.user_id, d.job_id, CASE WHEN p.norm > 0 THEN coalesce(dot / nullif(s.norm * p.norm, 0), 0) END AS similarity
    FROM {docs} d LEFT JOIN {name}_norm p ON p.user_id = d.user_id LEFT JOIN {name}_sums s ON s.user_id = d.user_id AND s.job_id = d.job_id)"""


_SKILL_TOKENS = tokens_sql("s")
_GENERIC = ", ".join(f"'{w}'" for w in sorted(K.GENERIC_SKILL_WORDS))
_CLEARANCE = r"(?i)\b(?:security|secret|government|dod|sci|public trust)[- ]+clearance\b|\bclearable\b|\bts/sci\b|\bu\.?s\.? citizen(?:ship)?\b|must be a citizen|\bitar\b"
_LEVELS = "MAP {'internship': 0, 'entry': 1, 'junior': 2, 'mid': 3, 'senior': 4, 'management': 5}"

RANK_SQL = f"""
WITH passages AS (SELECT item_id % 7 AS user_id, string_agg(text, chr(10) ORDER BY item_id) AS skills FROM benchmark GROUP BY 1)
, wanted AS (
  SELECT user_id, CASE WHEN user_id = 6 THEN 'the and of' ELSE concat('# Profile', chr(10), chr(10), '## Skills', chr(10), skills, chr(10), chr(10), '## Experience', chr(10), '- led others',
      CASE WHEN user_id % 2 = 0 THEN chr(10) || '- holds a secret clearance' ELSE '' END) END AS markdown,
    CASE WHEN user_id = 6 THEN 'the and of' ELSE concat('## Skills', chr(10), skills) END AS profile,
    {_list([y for y, _, _ in PREFERENCES])}[user_id + 1] AS max_years, {_list([levels for _, levels, _ in PREFERENCES])}[user_id + 1] AS levels, {_list([s for _, _, s in PREFERENCES])}[user_id + 1] AS sponsored
  FROM passages)
, waiting AS (SELECT DISTINCT user_id, doc_id AS job_id FROM (SELECT doc_id % 7 AS user_id, doc_id FROM documents UNION ALL SELECT 0, doc_id FROM documents WHERE doc_id % 3 = 0))
, split AS (SELECT doc_id, lang, text, string_split(text, ' ') AS w FROM documents)
, candidates AS (SELECT user_id, job_id, array_to_string(w[1:4], ' ') AS title, text AS body FROM waiting JOIN split ON doc_id = job_id)
{_tfidf_sql("by_words", "candidates", "markdown")}
, facts AS (
  SELECT doc_id AS job_id, {_list(SENIORITY)}[doc_id % 7 + 1] AS seniority,
    list_filter([w[5], concat_ws(' ', w[9], w[10]), w[14] || ' systems', CASE WHEN doc_id % 11 = 0 THEN 'secret clearance' END, CASE WHEN doc_id % 3 = 0 THEN w[21] END], lambda s: s IS NOT NULL) AS skills,
    array_to_string(w[20:59], ' ') AS digest, CASE WHEN doc_id % 4 > 0 THEN doc_id % 11 END AS years, CAST(lang = 'en' AS INTEGER) AS remote, array_to_string(w[1:4], ' ') AS title
  FROM split WHERE doc_id % 5 <> 4)
, known AS (SELECT w.user_id, f.*, concat('Seniority: ', seniority, '. Skills: ', array_to_string(skills, ', '), '. ', digest) AS body FROM waiting w JOIN facts f USING (job_id))
{_tfidf_sql("in_facts", "known", "profile")}
, skill_rows AS (
  SELECT user_id, job_id, s, i, {_SKILL_TOKENS} AS k FROM (SELECT user_id, job_id, unnest(list_transform(skills, lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13)))) AS s, generate_subscripts(skills, 1) AS i FROM known))
, profile_tokens AS (SELECT user_id, {tokens_sql("markdown")} AS whole, {tokens_sql("profile")} AS part FROM wanted)
, skill_hits AS (
  SELECT r.user_id, job_id, len(list_filter(k, lambda x: NOT list_contains(part, x))) = 0 AS held,
    list_has_any(CASE WHEN len(list_filter(k, lambda x: x NOT IN ({_GENERIC}))) > 0 THEN list_filter(k, lambda x: x NOT IN ({_GENERIC})) ELSE k END, whole) AS hit
  FROM skill_rows r JOIN profile_tokens p USING (user_id) WHERE len(k) > 0)
, skill_sums AS (
  SELECT user_id, job_id, CAST(count(*) FILTER (held) AS DOUBLE) / count(*) AS skills, CASE WHEN count(*) >= 3 THEN CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) END AS coverage FROM skill_hits GROUP BY ALL)
, users_vectors AS (SELECT vec_id AS user_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 7)
, nearness AS (SELECT user_id, job_id, list_cosine_similarity(embedding::DOUBLE[], q) AS similarity FROM waiting JOIN embeddings ON vec_id = job_id JOIN users_vectors USING (user_id))
, signals AS (
  SELECT k.user_id, k.job_id, e.similarity AS embedding, f.similarity AS words, coalesce(s.skills, 0.5) AS skills, s.coverage,
    CASE WHEN max_years > 0 AND years IS NOT NULL THEN greatest(0, years - max_years + 3) ELSE 0 END::DOUBLE AS near,
    coalesce(list_min(list_transform(list_filter(levels, lambda x: {_LEVELS}[x] IS NOT NULL), lambda x: abs({_LEVELS}[x] - {_LEVELS}[seniority]))), 1)::DOUBLE AS gap, remote::DOUBLE AS remote,
    regexp_matches(concat_ws(' ', digest, array_to_string(k.skills, ' ')), '{_CLEARANCE}') AND (sponsored OR NOT regexp_matches(markdown, '(?i)clearance|citizen')) AS blocked,
    max_years > 0 AND coalesce(years > max_years, false) AS too_many
  FROM known k JOIN wanted w USING (user_id) JOIN in_facts f ON f.user_id = k.user_id AND f.job_id = k.job_id
    LEFT JOIN skill_sums s ON s.user_id = k.user_id AND s.job_id = k.job_id LEFT JOIN nearness e ON e.user_id = k.user_id AND e.job_id = k.job_id)
, blended AS (SELECT user_id, job_id, {" + ".join(f"{w}::DOUBLE * coalesce(CASE WHEN stddev_pop({c}) OVER u > 0 THEN ({c} - avg({c}) OVER u) / stddev_pop({c}) OVER u END, 0)" for c, w in R.WEIGHTS.items())}
    - CASE WHEN blocked THEN 1.5::DOUBLE ELSE 0 END - CASE WHEN too_many THEN 4.0::DOUBLE ELSE 0 END AS blend FROM signals WINDOW u AS (PARTITION BY user_id))
, drawn AS (SELECT *, CASE WHEN max(blend) OVER u > min(blend) OVER u THEN 35 + 50 * (blend - min(blend) OVER u) / (max(blend) OVER u - min(blend) OVER u) ELSE 85 END AS scaled FROM blended WINDOW u AS (PARTITION BY user_id))
, guessed AS (
  SELECT *, CASE WHEN similarity IS NULL THEN 50 WHEN max(similarity) OVER u > min(similarity) OVER u THEN 35 + 50 * (similarity - min(similarity) OVER u) / (max(similarity) OVER u - min(similarity) OVER u) ELSE 85 END AS guess
  FROM by_words WINDOW u AS (PARTITION BY user_id))
SELECT g.user_id, g.job_id, round(g.similarity, 9) AS similarity, round(coalesce(scaled, round(guess)), 6) AS exact, CAST(round(coalesce(scaled, guess)) AS INTEGER) AS estimate
FROM guessed g LEFT JOIN drawn d ON d.user_id = g.user_id AND d.job_id = g.job_id
"""


@query(RANK_SQL, with_tables=False)
def ranked_pending(t: Tables) -> DataFrame:
    """All users' pending documents, from their texts to their ranks."""
    rows = K.rank_pending(profiles(t), postings(t), pending(t), facts(t), similar(t))
    return rows.select("user_id", "job_id", F.round("similarity", 9).alias("similarity"), F.round("exact", 6).alias("exact"), "estimate")
