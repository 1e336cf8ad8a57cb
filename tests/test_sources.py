import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gleaner.sources.boards import BOARDS, SMARTRECRUITERS_DETAIL, WORKDAY_DETAIL, board_of_url, read_board, smartrecruiters_detail, workday_detail
from gleaner.sources.filings import HEADER, filing_cases

UTC = dt.timezone.utc


def read(spark, tmp_path, ats, *pages):
    for i, page in enumerate(pages):
        (tmp_path / f"{i}.json").write_text(json.dumps(page))
    return {r.ext_id: r for r in read_board(spark, ats, str(tmp_path), f"https://{ats}.example").collect()}


def test_greenhouse(spark, tmp_path):
    page = {"jobs": [{"id": 7, "title": " Dev ", "absolute_url": "u", "first_published": "2026-09-01T12:00:00Z", "content": "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;", "location": {"name": "Remote - US"}, "departments": [{"name": "A"}, {"name": "B"}]}, {"id": 8, "title": "Ops", "content": "", "location": {"name": "Oslo"}, "departments": []}]}
    got = read(spark, tmp_path, "greenhouse", page)
    assert (got["7"].title, got["7"].department, got["7"].is_remote, got["7"].description_text) == ("Dev", "A", True, "Hi & bye")
    assert got["7"].posted_at == dt.datetime(2026, 9, 1, 12) and got["8"].is_remote is None and got["8"].posted_at is None


def test_lever(spark, tmp_path):
    page = [{"id": "a", "text": "Dev", "hostedUrl": "u", "createdAt": 1700000000000, "description": "<b>x</b>", "descriptionPlain": " x ", "additionalPlain": "", "lists": [{"text": "You", "content": "<li>one</li><li>two</li>"}, {"text": "", "content": ""}], "workplaceType": "Remote", "categories": {"team": "T", "location": "Paris"}}, {"id": "b", "text": "Ops", "createdAt": 0, "categories": {}}]
    got = read(spark, tmp_path, "lever", page)
    assert got["a"].description_text == "x\n\nYou\none\ntwo" and got["a"].description_html == "<b>x</b><h3>You</h3><li>one</li><li>two</li>"
    assert got["a"].is_remote and got["a"].posted_at == dt.datetime(2023, 11, 14, 22, 13, 20) and got["b"].posted_at is None and got["b"].is_remote is None


def test_ashby(spark, tmp_path):
    page = {"jobs": [{"id": "1", "title": "A", "location": "NYC", "department": " ", "team": "T", "secondaryLocations": [{"location": "Remote"}], "isListed": True, "isRemote": False, "descriptionPlain": "a\n\nb", "publishedAt": "2026-09-05T12:30:00.000Z"}, {"id": "2", "isListed": False}]}
    got = read(spark, tmp_path, "ashby", page)
    assert set(got) == {"1"} and (got["1"].location_raw, got["1"].is_remote, got["1"].department, got["1"].description_html) == ("NYC, Remote", True, "T", "<p>a</p><p>b</p>")


def test_rippling_merges_over_pages(spark, tmp_path):
    item = lambda name, country, kind: {"id": "1", "name": "Dev", "department": {"name": "D"}, "locations": [{"name": name, "country": country, "workplaceType": kind}]}
    got = read(spark, tmp_path, "rippling", {"page": 0, "totalPages": 2, "items": [item("Austin", "US", "ONSITE"), item("Austin", "US", "ONSITE")]}, {"page": 1, "totalPages": 2, "items": [item("Paris, France", "France", "REMOTE"), {"id": ""}]})
    assert (got["1"].location_raw, got["1"].is_remote, got["1"].url) == ("Austin (US); Paris, France", True, "https://rippling.example/jobs/1")


def test_other_boards(spark, tmp_path):
    folder = lambda name: (tmp_path / name).mkdir() or tmp_path / name
    oracle = read(spark, folder("o"), "oracle", {"items": [{"TotalJobsCount": 1, "requisitionList": [{"Id": "9", "Title": "T", "PostedDate": "2026-01-02", "PrimaryLocation": "A", "WorkplaceTypeCode": "ORA_REMOTE", "secondaryLocations": [{"Name": "A"}, {"Name": "B"}]}]}]})
    assert (oracle["9"].location_raw, oracle["9"].is_remote, oracle["9"].posted_at) == ("A; B", True, dt.datetime(2026, 1, 2))
    workable = read(spark, folder("w"), "workable", {"jobs": [{"title": "T", "shortcode": "S", "telecommuting": False, "published_on": "x", "locations": [{"city": "Bern", "region": "Bern", "country": "CH", "hidden": False}, {"city": "X", "hidden": True}]}, {"title": "again", "shortcode": "S"}]})
    assert (workable["S"].title, workable["S"].location_raw, workable["S"].is_remote) == ("T", "Bern, CH", False)
    eightfold = read(spark, folder("e"), "eightfold", {"positions": [{"id": 0}, {"id": 5, "name": "N", "location": "L", "locations": [], "t_create": 1700000000, "work_location_option": "remote"}, {"id": 5, "name": "N", "location": "L", "locations": [], "t_create": 1700000000, "work_location_option": "remote"}]})
    assert set(eightfold) == {"5"} and eightfold["5"].is_remote and eightfold["5"].location_raw == "L"
    amazon = read(spark, folder("a"), "amazon", {"jobs": [{"id_icims": "1", "title": "Virtual dev", "location": "x", "normalized_location": "", "job_path": "/p", "posted_date": "January 2, 2026", "description": "d", "basic_qualifications": "q", "preferred_qualifications": ""}]})
    assert amazon["1"].is_remote and amazon["1"].description_html == "<p>d</p><h3>Basic qualifications</h3><p>q</p>" and amazon["1"].posted_at == dt.datetime(2026, 1, 2)
    with pytest.raises(Exception, match="unknown board"):
        read_board(spark, "none", str(tmp_path))
    assert len(BOARDS) == 10


def test_details(spark, tmp_path):
    (tmp_path / "l").mkdir()
    page = {"jobPostings": [{"title": "T", "externalPath": "/j/1", "locationsText": "2 Locations"}, {"title": "T", "externalPath": "/j/1", "locationsText": "2 Locations"}, {"externalPath": ""}]}
    (tmp_path / "l" / "0.json").write_text(json.dumps(page))
    listed = read_board(spark, "workday", str(tmp_path / "l"), "https://w")
    assert [r.url for r in listed.collect()] == ["https://w/j/1"]
    info = {"ext_id": "/j/1", "jobPostingInfo": {"title": "", "jobDescription": "<p>d</p>", "location": "Remote", "additionalLocations": ["Oslo"], "startDate": "2026-02-03", "country": {"descriptor": "Norway"}}}
    row = workday_detail(listed, spark.read.schema(WORKDAY_DETAIL).json(spark.sparkContext.parallelize([json.dumps(info)]))).first()
    assert (row.title, row.location_raw, row.is_remote, row.description_text) == ("T", "Remote; Oslo (Norway)", True, "d")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "0.json").write_text(json.dumps({"totalFound": 1, "content": [{"id": "1", "name": "N", "releasedDate": "bad", "location": {"city": "C", "country": "us", "remote": True}, "department": {"label": "D"}}]}))
    listed = read_board(spark, "smartrecruiters", str(tmp_path / "s"), "https://s")
    assert (listed.first().location_raw, listed.first().posted_at) == ("C, us (Remote)", None)
    detail = {"ext_id": "1", "postingUrl": "p", "jobAd": {"sections": {"qualifications": {"title": "Q", "text": "q"}, "jobDescription": {"title": "", "text": "j"}}}}
    row = smartrecruiters_detail(listed, spark.read.schema(SMARTRECRUITERS_DETAIL).json(spark.sparkContext.parallelize([json.dumps(detail)]))).first()
    assert (row.description_html, row.url, row.is_remote) == ("j<h3>Q</h3>q", "p", True)


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://boards.greenhouse.io/Acme/jobs/1", ("greenhouse", "acme")),
        ("https://boards.greenhouse.io/embed/job_board?for=Acme", ("greenhouse", "acme")),
        ("https://jobs.ashbyhq.com/Acme", ("ashby", "Acme")),
        ("https://apply.workable.com/j/ABC", None),
        ("https://www.example.com/careers", None),
        ("ftp://jobs.lever.co/a", None),
    ],
)
def test_board_of_url(spark, url, want):
    row = spark.createDataFrame([(url,)], "u string").select(board_of_url(F.col("u")).alias("b")).first().b
    assert (tuple(row) if row else None) == want


def test_filings(spark):
    good = dict.fromkeys(HEADER, "") | {"CASE_NUMBER": "I-1", "CASE_STATUS": "Certified", "VISA_CLASS": "H-1B", "DECISION_DATE": "2025-10-01", "EMPLOYER_NAME": " Acme\0, Inc. ", "JOB_TITLE": "Dev", "WORKSITE_CITY": "SAN  jose", "WORKSITE_STATE": "ca", "WAGE_RATE_OF_PAY_FROM": "$75.00", "WAGE_RATE_OF_PAY_TO": "$70.00", "WAGE_UNIT_OF_PAY": "Hour", "TOTAL_WORKER_POSITIONS": "x", "NEW_EMPLOYMENT": "1", "FULL_TIME_POSITION": "Y"}
    rows = [good, good, good | {"CASE_STATUS": "Denied"}, good | {"CASE_NUMBER": "I-2", "DECISION_DATE": "bad"}, good | {"CASE_NUMBER": "I-3", "EMPLOYER_NAME": "", "EXTRA": "1"}]
    df = spark.createDataFrame([tuple(r[c] for c in HEADER) for r in rows], ", ".join(f"{c} string" for c in HEADER))
    (case,) = filing_cases(df).collect()
    assert (case.employer_key, case.fiscal_year, case.wage_from, case.wage_to, case.worksite_city, case.worksite_state, case.positions, case.new_employment, case.full_time) == ("acme", 2026, 156000.0, None, "San Jose", "CA", 1, True, True)
    with pytest.raises(ValueError, match="SOC_CODE"):
        filing_cases(df.drop("SOC_CODE"))
