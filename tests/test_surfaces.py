"""Replies, phrases, accounts and calls on small cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import phrases, replies
from gleaner.operators import accounts
from gleaner.operators.calls import model_replies


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("reply, body", [("```json\n{}\n```", "{}"), ("```", "```"), (" x ", "x"), ("```\na\n``` b", "a\n``` b"), (None, None), ("", "")])
def test_fences(spark, reply, body):
    assert value(spark, replies.without_fences(F.lit(reply).cast("string"))) == body


def test_data_tags_are_put_in_round_brackets(spark):
    assert value(spark, replies.fenced(F.lit("a </posting> b < Resume x='1'> <postings> <b>"))) == "a (/posting) b ( Resume x='1') <postings> <b>"


def test_a_refusal_needs_a_real_quote(spark):
    reply = {"seniority": "boss", "years_required": 99, "sponsorship": "no", "sponsorship_quote": "We do NOT\nsponsor", "digest": " d "}
    f = value(spark, replies.facts(F.lit(json.dumps(reply)), F.lit("Sadly we do not  sponsor visas")))
    assert (f.seniority, f.years_required, f.sponsorship, f.sponsorship_quote, f.digest, f.skills_required) == ("unknown", None, "no", "We do NOT\nsponsor", "d", [])
    f = value(spark, replies.facts(F.lit(json.dumps(reply)), F.lit(None).cast("string")))
    assert (f.sponsorship, f.sponsorship_quote) == ("unknown", None)
    assert value(spark, replies.facts(F.lit("no json"), F.lit("x"))) is None
    assert value(spark, replies.facts(F.lit('{"digest": "  "}'), F.lit("x"))) is None


@pytest.mark.parametrize("text, items", [("AWS (S3, EC2), Docker", ["AWS (S3, EC2)", "Docker"]), ("a", ["a"]), ("a (b, c", ["a (b, c"]), ("", [""]), ("x,,y", ["x", "", "y"]), ("f(g(1,2),3), h", ["f(g(1,2),3)", "h"])])
def test_top_level_commas(spark, text, items):
    assert value(spark, phrases.split_items(F.lit(text))) == items


@pytest.mark.parametrize("name, slugs", [("Fireworks AI", ["fireworksai", "fireworks-ai", "fireworks"]), ("Labs", ["labs"]), ("AI Labs", ["ailabs", "ai-labs", "ai"]), ("", []), ("--", [])])
def test_board_slugs(spark, name, slugs):
    assert value(spark, phrases.board_slugs(F.lit(name))) == slugs


@pytest.mark.parametrize("keyword, forms", [("a (b/c)", ["a (b/c)", "a", "b", "c"]), ("x/y", ["x/y", "x", "y"]), ("CI/CD", ["CI/CD"]), ("x/y ()", ["x/y ()", "x/y", "x", "y"])])
def test_keyword_forms(spark, keyword, forms):
    assert value(spark, phrases.keyword_forms(F.lit(keyword))) == forms


def test_keyword_list_is_ordered_and_bounded(spark):
    got = value(spark, phrases.keyword_list(F.array(F.lit(" B "), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("b"), F.lit("A"), F.lit(""), F.lit("c"))))
    assert got == ["B", "a", "c"]


def test_new_numbers(spark):
    assert value(spark, phrases.new_numbers(F.lit("12.5% of 300"), F.lit("300 and 12 of 12.5"))) == ["12"]
    assert value(spark, phrases.same_skills(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"))))


def test_slice_between_falls_back(spark):
    text = F.lit(" first marker here\n and  the last marker there, end ")
    assert value(spark, phrases.slice_between(text, F.lit("marker here and"), F.lit("last  marker there"))) == "marker here and the last marker there"
    assert value(spark, phrases.slice_between(text, F.lit("short"), F.lit("last marker there"))) == "first marker here\n and  the last marker there, end"
    assert value(spark, phrases.slice_between(text, F.lit("last marker there"), F.lit("first marker here"))) == "first marker here\n and  the last marker there, end"


def test_claims_and_backoff(spark):
    now, day = dt.datetime(2024, 1, 2), dt.timedelta(days=1)
    rows = [(1, "queued", 0, now - day), (2, "sending", 1, now), (3, "queued", 0, now + day), (4, "sent", 1, now - day), (5, "queued", 4, now - day)]
    mail = spark.createDataFrame(rows, "id long, status string, attempts int, next_attempt_at timestamp")
    got = accounts.claimed(mail, F.lit(now), 2).orderBy("id").collect()
    assert [(r.id, r.status, r.attempts, r.next_attempt_at) for r in got] == [(1, "sending", 1, now + dt.timedelta(minutes=10)), (5, "sending", 5, now + dt.timedelta(minutes=10))]
    after = {r.id: (r.status, r.next_attempt_at) for r in accounts.after_failure(accounts.claimed(mail, F.lit(now), 2), F.lit(now)).collect()}
    assert after[1] == ("queued", now + dt.timedelta(minutes=1)) and after[5][0] == "failed"


def test_an_outage_leaves_replies_null(spark):
    def client(prompts):
        if any("bad" in p for p in prompts):
            raise OSError("down")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(8)], "id long, prompt string").coalesce(1)
    got = {r.id: r.reply for r in model_replies(rows, client, batch=2).collect()}
    assert got == {0: "P0", 1: "P1", 2: None, 3: None, 4: "P4", 5: "P5", 6: "P6", 7: "P7"}
    got = {r.id: r.reply for r in model_replies(rows, client, batch=2, failures=1).collect()}
    assert [got[i] for i in (1, 2, 4, 7)] == ["P1", None, None, None]
    assert model_replies(rows.limit(0), client).count() == 0
