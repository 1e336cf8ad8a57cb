import pytest
from pyspark.sql import functions as F

from gleaner.operators.rules import Catalog, Preferences, apply_rules, facts_reason, moderation_reason

CATALOG = Catalog(
    families={"software": [r"\bsoftware (engineer|developer)", r"\bmember of technical staff\b"], "sre": [r"\bsite reliability\b", r"\bSRE\b"], "nursing": [r"\bnurse\b"]},
    levels={"senior": ([r"\bsenior\b", r"\bsr\b\.?", r"\bstaff\b", r"\blead\b"], [r"member of technical staff", r"staff nurse"]), "mid": ([], [])},
    overrides={"mts_infra": (["software"], [r"member of technical staff - systems"])},
    home=[r"united states", r"\busa\b", r"remote[- ]us\b", r"\bCA\b"],
    abroad=[r"canada", r"germany", r"london"],
    refusals=[r"(not|unable to)\s+(provide|offer)?\s*sponsor", r"without\s+sponsorship"],
    flags=[r"U\.S\. persons?", r"\bitar\b"],
)
ENTRY = Preferences(["software", "sre", "nursing"], ["entry", "mid"], us_only=True, needs_sponsorship=True, max_years=3)


@pytest.mark.parametrize(
    "title, location, reason",
    [
        ("Senior SRE", "Remote", "title:senior"),
        ("Sr. Software Engineer", "", "title:sr"),
        ("Staff Software Engineer", None, "title:staff"),
        ("Member of Technical Staff", "Remote", None),
        ("Senior Member of Technical Staff - Systems", "Remote", None),
        ("Staff Nurse II", "Remote", None),
        ("Senior Staff Nurse", "Remote", "title:senior"),
        ("Account Executive", "Remote", "title:no_category"),
        ("Software Engineer", "Toronto, Canada", "location:non_us"),
        ("Software Engineer", "London or Remote-US", None),
        ("Software Engineer", "Mars", None),
    ],
)
def test_titles(spark, title, location, reason):
    rows = apply_rules(spark.createDataFrame([(title, location, "text")], "title string, location string, description string"), ENTRY, CATALOG)
    assert rows.first().reason == reason


def test_descriptions(spark):
    texts = ["We are unable to\nsponsor visas. Thanks.", "Visa sponsorship offered!", "Only U.S. persons. ITAR.", None, "without sponsorship"]
    rows = spark.createDataFrame([("Software developer", "", t) for t in texts], "title string, location string, description string")
    got = [(r.reason, r.evidence, list(r.categories), list(r.flags)) for r in apply_rules(rows, ENTRY, CATALOG).collect()]
    assert got[0][0] == "sponsorship:explicit_no" and "unable to" in got[0][1]
    assert got[1] == (None, None, ["software"], []) and got[2][3] == ["u_s_persons", "itar"] and got[3][0] is None
    assert got[4][:2] == ("sponsorship:explicit_no", "without sponsorship")
    easy = Preferences(["software"], ["senior", "mid"])
    assert all(r.reason is None for r in apply_rules(rows, easy, CATALOG).collect())


def test_facts_ladder(spark):
    rows = [("no", "q", 1, True, "mid"), ("no", "", 5, True, "mid"), ("no", None, 3, False, "senior"), (None, None, None, None, "senior"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "sponsorship string, quote string, years int, us_eligible boolean, seniority string")
    facts = {c: F.col(c) for c in df.columns}
    assert [r.x for r in df.select(facts_reason(facts, ENTRY).alias("x")).collect()] == ["llm:sponsorship_no", "llm:years>3", "llm:non_us", "llm:senior", None]


@pytest.mark.parametrize("title, body, reason", [("short", "b" * 30, "title_length"), ("a good title", "x" * 9 + " " * 300, "body_length"), ("a good title", "http://a " * 6 + "words " * 40, "links"), ("a good title", "ab" * 100 + "!" * 15, "long_run"), ("a good title" + "!" * 9, "!" * 9 + "ab" * 100, "long_run"), ("a good title", "ab" * 100 + "-" * 40, None)])
def test_moderation(spark, title, body, reason):
    row = spark.createDataFrame([(title, body)], "t string, b string").select(moderation_reason(F.col("t"), F.col("b")).alias("r")).first()
    assert row.r == reason


def test_moderation_of_comments(spark):
    rows = spark.createDataFrame([("ok",), ("x",), ("http://a http://b http://c",)], "b string").select(moderation_reason(F.lit(None).cast("string"), F.col("b"), "comment").alias("r")).collect()
    assert [r.r for r in rows] == [None, "body_length", "links"]
