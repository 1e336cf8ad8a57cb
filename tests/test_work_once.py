"""What a row's expressions read more than once is computed once, and small rows with much work are dealt over the tasks."""

import time

import pytest
from pyspark.sql import functions as F

from gleaner.catalog import QUERIES
from gleaner.functions import phrases, review
from gleaner.operators import ranking

TABLES = "/root/testdata/sf0.001"


def plans(spark, name):
    """The optimized and the physical plan of a query, whole."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        execution = QUERIES[name](spark, TABLES)._jdf.queryExecution()
        return execution.optimizedPlan().toString(), execution.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_known_terms_split_a_text_once(spark):
    plan, physical = plans(spark, "term_hits")
    assert plan.count("split(") <= 2  # words, and parts between slashes
    assert "REPARTITION_BY_COL" in physical


def test_keyword_coverage_splits_a_text_once(spark):
    plan, physical = plans(spark, "keyword_share")
    assert plan.count("[^a-z0-9+#./]+, -1") == 1
    assert "REPARTITION_BY_COL" in physical


def test_form_answers_clean_a_value_once(spark):
    plan, physical = plans(spark, "form_answers")
    assert plan.count("from_json") == 1 and plan.count("```") <= 4
    assert "REPARTITION_BY_COL" in physical


def test_scrubbed_postings_are_dealt_over_the_tasks(spark):
    assert "REPARTITION_BY_COL" in plans(spark, "scrubbed_postings")[1]


@pytest.mark.parametrize("text", ["AWS (S3, EC2), Docker", "a", "a (b, c", "", "x,,y", "f(g(1,2),3), h", "a), b, (c, d", ",", "(", "a),(b,c"])
def test_items_are_counted_as_they_are_split(spark, text):
    row = spark.range(1).select(F.size(phrases.split_items(F.lit(text))).alias("n"), phrases.count_items(F.lit(text)).alias("counted")).first()
    assert row.n == row.counted


def test_a_long_line_of_items_is_counted_in_linear_time(spark):
    """40,000 items, with brackets and without: a fold that holds the items copies 800 million of them."""
    plain, brackets = "item one, " * 40000, "item (one, two), " * 20000
    frame = spark.createDataFrame([(plain,), (brackets,)], "x string")
    began = time.time()
    assert [r.n for r in frame.select(phrases.count_items(F.col("x")).alias("n")).collect()] == [40001, 20001]
    assert time.time() - began < 20


def test_a_review_copies_no_sections(spark):
    """No transform of the review makes whole sections or entries, which it would copy with all their texts."""
    frame = spark.createDataFrame([], f"resume {review.RESUME}, pages int")
    plan = frame.select(review.review(F.col("resume"), F.col("pages")), review.plain_text(F.col("resume")))._jdf.queryExecution().analyzed().toString()
    assert "struct(x, " not in plan and "split(" in plan and "array_append" not in plan


def test_skills_meet_a_profile_once_for_each_pair(spark):
    """What the skills of a posting share with a profile is found once, not anew for each skill."""
    texts, flag = "array<string>", "boolean"
    fields = {"user_id": "long", "job_id": "long", "seniority": "string", "skills": texts, "digest": "string", "years": "int", "work_mode": "string", "markdown": "string", "max_years": "int", "levels": texts, "needs_sponsorship": flag, "_profile": texts, "_whole": texts}
    known = spark.createDataFrame([(1, 2, "mid", ["Go", "Big data"], "", 1, "remote", "", 0, ["mid"], False, ["go", "big"], ["big"])], ", ".join(f"{k} {v}" for k, v in fields.items()))
    words = spark.createDataFrame([(1, 2, 0.5)], "user_id long, job_id long, similarity double")
    found = ranking.signals(known, words, None, "user_id", "job_id")
    assert found._jdf.queryExecution().analyzed().toString().count("array_intersect(flatten(") == 2
    assert found.first().skills == 0.5
