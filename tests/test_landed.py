import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.sources.boards import board_of_url
from gleaner.sources.landed import board_listings, current_etags, land, landed
from gleaner.streaming.buckets import posting_table
from gleaner.streaming.lifecycle import posting_stream

STORED = "source string, ext_id string, title string, location_raw string, url string, description_text string, content_hash long, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp"


def page(*jobs):
    return {"jobs": [{"id": i, "title": t, "absolute_url": f"https://x/{i}", "content": "", "location": {"name": "Oslo"}, "departments": []} for i, t in jobs]}


def test_an_unchanged_board_gives_an_empty_batch(spark, tmp_path):
    root, batches = str(tmp_path / "boards"), []
    land(root, "g", "v1", [page((1, "A"), (2, "B")), page((3, "C"))])
    land(root, "h", "v1", [page((9, "H"))])
    assert [(r.board, r.etag, r.page) for r in landed(spark, root).orderBy("board", "page").collect()] == [("g", "v1", "000000.json"), ("g", "v1", "000001.json"), ("h", "v1", "000000.json")]

    def poll():
        seen = []
        query = landed(spark, root, stream=True).writeStream.foreachBatch(lambda df, n: seen.extend((r.board, r.etag, r.page) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        batches.append(sorted(seen))
        return batches[-1]

    assert poll() == [("g", "v1", "000000.json"), ("g", "v1", "000001.json"), ("h", "v1", "000000.json")]
    assert poll() == []  # no ETag changed, a restart included
    land(root, "g", "v2", [page((1, "A2"))])
    assert poll() == [("g", "v2", "000000.json")]  # h is not read again
    assert current_etags(root) == {"g": "v2", "h": "v1"}


def test_boards_into_the_posting_table(spark, tmp_path):
    """First fetch: two new; same version: nothing; then one closes, one changes, one is new."""
    root, table = str(tmp_path / "boards"), posting_table(spark, str(tmp_path / "postings"), STORED)

    def run(day):
        live = board_listings(landed(spark, root, stream=True), "greenhouse", "acme", F.lit(dt.datetime(2024, 1, day)))
        posting_stream(live, table, str(tmp_path / "checkpoint")).awaitTermination()
        return {r.ext_id: r for r in table.read().collect()}

    land(root, "acme", "v1", [page((1, "Reliability"), (2, "Platform"))])
    rows = run(1)
    assert {k: r.title for k, r in rows.items()} == {"1": "Reliability", "2": "Platform"} and {r.source for r in rows.values()} == {"greenhouse/acme"}
    before = table.version()
    assert run(2) == rows and table.version() == before
    land(root, "acme", "v2", [page((1, "Reliability II"), (3, "Operations"))])
    rows = run(3)
    assert {k: r.title for k, r in rows.items() if r.closed_at is None} == {"1": "Reliability II", "3": "Operations"}
    assert rows["2"].closed_at == dt.datetime(2024, 1, 3) and rows["1"].first_seen_at == dt.datetime(2024, 1, 1)


def test_a_broken_page_fails_the_batch(spark, tmp_path):
    root = str(tmp_path / "boards")
    land(root, "acme", "v1", [page((1, "A"))])
    (tmp_path / "boards" / "acme" / "v1" / "000001.json").write_text("<html>busy</html>")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        board_listings(landed(spark, root), "greenhouse", "acme", F.lit(dt.datetime(2024, 1, 1))).collect()


def test_boards_by_path_and_by_host(spark):
    known = {
        "https://boards.greenhouse.io/Acme/jobs/123?gh_src=x": ("greenhouse", "acme"),
        "https://boards.greenhouse.io/embed/job_app?for=acme&token=89": ("greenhouse", "acme"),
        "https://jobs.ashbyhq.com/Acme/abc-def": ("ashby", "Acme"),
        "https://acme.wd5.myworkdayjobs.com/en-US/AcmeCareers/job/US-CA/Engineer_JR1": ("workday", "acme.wd5/AcmeCareers"),
        "https://acme.wd1.myworkdayjobs.com/AcmeCareers/details/RN_R123": ("workday", "acme.wd1/AcmeCareers"),
        "https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/Site/jobs": ("workday", "acme.wd1/Site"),
        "https://wd5.myworkdaysite.com/en-US/recruiting/Acme/AcmeCareers/job/x": ("workday", "acme.wd5/AcmeCareers"),
        "https://wd5.myworkdaysite.com/recruiting/acme/Site": ("workday", "acme.wd5/Site"),
        "https://acme.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1001/job/2106": ("oracle", "acme.fa/CX_1001"),
        " http://WWW.acme.fa.em3.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX/job/4": ("oracle", "acme.fa.em3/CX"),
    }
    others = ["https://careers.example.com/jobs/1", "https://acme.wd5.myworkdayjobs.com/", "https://acme.wd5.myworkdayjobs.com/en-US", "ftp://jobs.lever.co/acme", "https://apply.workable.com/j/3B", "https://wd5.myworkdaysite.com/acme/Site/x"]
    others += ["https://acme.fa.oraclecloud.com/hcmUI/CandidateExperience/en/my-profile", "https://acme.fa.oraclecloud.com/sites", "https://acme.oraclecloud.com/sites/CX", "", None]
    got = {r.u: r.b and tuple(r.b) for r in spark.createDataFrame([(u,) for u in [*known, *others]], "u string").select("u", board_of_url(F.col("u")).alias("b")).collect()}
    assert got == known | dict.fromkeys(others)
