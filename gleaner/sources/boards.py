"""Readers of landed board snapshots: nested JSON with an explicit schema in, one posting a row out.

Fetching is done before: pages land as JSON files. Each reader takes the parsed pages and gives the columns ext_id,
title, location_raw, url, department, description_html, description_text, is_remote (null: not said) and posted_at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import html_to_text, trimmed

COLUMNS = ["ext_id", "title", "location_raw", "url", "department", "description_html", "description_text", "is_remote", "posted_at"]


def _posting(rows: DataFrame, **given: Column) -> DataFrame:
    kinds = {"is_remote": "boolean", "posted_at": "timestamp"}
    return rows.select(*[given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def _clean(c: Column) -> Column:
    return trimmed(F.coalesce(c, F.lit("")))


def _says_remote(c: Column) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("remote"))


def _is(c: Column, word: str) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))) == word


def _time(c: Column, *formats: str | None) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) if f else F.try_to_timestamp(c) for f in formats])


def _joined(parts: Column, glue: str) -> Column:
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), glue)


GREENHOUSE = "jobs array<struct<id: bigint, title: string, absolute_url: string, first_published: string, content: string, location: struct<name: string>, departments: array<struct<name: string>>>>"


def greenhouse(pages: DataFrame) -> DataFrame:
    """The content is HTML with escaped tags; a posting is remote only where its location says so, else that is unknown."""
    j = F.col("j")
    rows = pages.select(F.explode("jobs").alias("j"))
    location = _clean(j["location"]["name"])
    return _posting(
        rows.withColumn("text", html_to_text(j["content"])),
        ext_id=j["id"].cast("string"),
        title=_clean(j["title"]),
        location_raw=location,
        url=j["absolute_url"],
        department=F.coalesce(F.try_element_at(j["departments"], F.lit(1))["name"], F.lit("")),
        description_html=F.replace(F.replace(F.replace(F.replace(j["content"], F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")),
        description_text=F.col("text"),
        is_remote=F.when(_says_remote(location), True),
        posted_at=_time(j["first_published"], None, "yyyy-MM-dd"),
    )


LEVER = "id string, text string, hostedUrl string, createdAt bigint, description string, descriptionPlain string, additionalPlain string, lists array<struct<text: string, content: string>>, workplaceType string, categories struct<team: string, location: string>"


def lever(rows: DataFrame) -> DataFrame:
    """One row a posting; the text is the plain body, the sections with their headings, and what is additional, blank lines between."""
    lists = F.coalesce("lists", F.array().cast("array<struct<text: string, content: string>>"))
    texts = html_to_text(F.array_join(F.transform(lists, lambda s: F.coalesce(s["content"], F.lit(""))), "\0"))
    rows = rows.withColumn("_bodies", F.split(texts, "\0"))
    sections = F.transform(lists, lambda s, i: _joined(F.array(_clean(s["text"]), _clean(F.try_element_at("_bodies", i + 1))), "\n"))
    text = _joined(F.concat(F.array(_clean(F.col("descriptionPlain"))), sections, F.array(_clean(F.col("additionalPlain")))), "\n\n")
    markup = F.concat(F.coalesce("description", F.lit("")), F.array_join(F.transform(lists, lambda s: F.concat(F.when(F.coalesce(s["text"], F.lit("")) != "", F.concat(F.lit("<h3>"), s["text"], F.lit("</h3>"))).otherwise(""), F.coalesce(s["content"], F.lit("")))), ""))
    location = _clean(F.col("categories.location"))
    return _posting(
        rows,
        ext_id=F.col("id"),
        title=_clean(F.col("text")),
        location_raw=location,
        url=F.col("hostedUrl"),
        department=_clean(F.col("categories.team")),
        description_html=markup,
        description_text=text,
        is_remote=F.when(_is(F.col("workplaceType"), "remote") | _says_remote(location), True),
        posted_at=F.when(F.col("createdAt") > 0, F.timestamp_millis("createdAt")),
    )


ASHBY = "jobs array<struct<id: string, title: string, location: string, department: string, team: string, jobUrl: string, secondaryLocations: array<struct<location: string>>, isListed: boolean, isRemote: boolean, workplaceType: string, publishedAt: string, descriptionHtml: string, descriptionPlain: string>>"


def ashby(pages: DataFrame) -> DataFrame:
    """Postings that are not listed are left out; all locations count."""
    j = F.col("j")
    rows = pages.select(F.explode("jobs").alias("j")).where(F.coalesce(j["isListed"], F.lit(False)))
    others = F.coalesce(F.transform(j["secondaryLocations"], lambda s: s["location"]), F.array().cast("array<string>"))
    location = _joined(F.concat(F.array(_clean(j["location"])), others), ", ")
    plain = F.coalesce(j["descriptionPlain"], F.lit(""))
    made = F.when(plain != "", F.concat(F.lit("<p>"), F.replace(plain, F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p>"))).otherwise("")
    return _posting(
        rows,
        ext_id=j["id"],
        title=_clean(j["title"]),
        location_raw=location,
        url=j["jobUrl"],
        department=F.coalesce(F.nullif(_clean(j["department"]), F.lit("")), _clean(j["team"])),
        description_html=F.coalesce(F.nullif(j["descriptionHtml"], F.lit("")), made),
        description_text=plain,
        is_remote=F.coalesce(j["isRemote"], F.lit(False)) | _is(j["workplaceType"], "remote") | _says_remote(location),
        posted_at=_time(j["publishedAt"], None),
    )


WORKDAY = "total int, jobPostings array<struct<title: string, externalPath: string, locationsText: string>>"


def workday(pages: DataFrame, site: str) -> DataFrame:
    """List pages may repeat a posting; each path is kept once."""
    p = F.col("p")
    rows = pages.select(F.explode("jobPostings").alias("p")).where(F.coalesce(p["externalPath"], F.lit("")) != "")
    rows = rows.groupBy(p["externalPath"].alias("path")).agg(F.min(F.struct(p["title"].alias("title"), p["locationsText"].alias("place"))).alias("first"))
    return _posting(rows, ext_id=F.col("path"), title=_clean(F.col("first.title")), location_raw=F.col("first.place"), url=F.concat(F.lit(site), F.col("path")))


WORKDAY_DETAIL = "ext_id string, jobPostingInfo struct<title: string, jobDescription: string, location: string, additionalLocations: array<string>, startDate: string, externalUrl: string, country: struct<descriptor: string>>"


def workday_detail(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Listed postings with their details; the country is added where no location names it."""
    i = F.col("jobPostingInfo")
    rows = listed.join(details, "ext_id")
    places = _joined(F.concat(F.array(i["location"]), F.coalesce(i["additionalLocations"], F.array().cast("array<string>"))), "; ")
    country = F.coalesce(i["country"]["descriptor"], F.lit(""))
    place = F.when((country != "") & ~F.contains(places, country), F.concat(places, F.lit(" ("), country, F.lit(")"))).otherwise(places)
    return _posting(
        rows.withColumn("_text", html_to_text(i["jobDescription"])),
        ext_id=F.col("ext_id"),
        title=F.coalesce(F.nullif(_clean(i["title"]), F.lit("")), F.col("title")),
        location_raw=place,
        url=F.coalesce(F.nullif(i["externalUrl"], F.lit("")), F.col("url")),
        department=F.col("department"),
        description_html=i["jobDescription"],
        description_text=F.col("_text"),
        is_remote=_says_remote(place),
        posted_at=_time(i["startDate"], "yyyy-MM-dd"),
    )


ORACLE = "items array<struct<TotalJobsCount: int, requisitionList: array<struct<Id: string, Title: string, PostedDate: string, PrimaryLocation: string, WorkplaceTypeCode: string, WorkplaceType: string, secondaryLocations: array<struct<Name: string>>>>>>"


def oracle(pages: DataFrame, site: str) -> DataFrame:
    """Locations are the primary one and the secondary ones that differ from it."""
    r = F.col("r")
    rows = pages.select(F.explode(F.try_element_at("items", F.lit(1))["requisitionList"]).alias("r")).where(F.coalesce(r["Id"], F.lit("")) != "")
    first = _clean(r["PrimaryLocation"])
    others = F.filter(F.transform(F.coalesce(r["secondaryLocations"], F.array().cast("array<struct<Name: string>>")), lambda s: _clean(s["Name"])), lambda s: s != first)
    location = _joined(F.concat(F.array(first), others), "; ")
    remote = (r["WorkplaceTypeCode"].eqNullSafe(F.lit("ORA_REMOTE"))) | _is(r["WorkplaceType"], "remote") | _says_remote(location)
    return _posting(rows, ext_id=r["Id"], title=_clean(r["Title"]), location_raw=location, url=F.concat(F.lit(site + "/job/"), r["Id"]), is_remote=remote, posted_at=_time(r["PostedDate"], "yyyy-MM-dd"))


RIPPLING = "items array<struct<id: string, name: string, url: string, department: struct<name: string>, locations: array<struct<name: string, country: string, workplaceType: string>>>>, totalPages int, page int"


def rippling(pages: DataFrame, site: str) -> DataFrame:
    """A posting has a row for each location, over pages: they are merged, locations in order and once, remote if any is."""
    i, at = F.col("i"), F.struct("page", "place")
    rows = pages.select("page", F.posexplode("items").alias("place", "i")).where(F.coalesce(i["id"], F.lit("")) != "")

    def named(x: Column) -> Column:
        name, country = _clean(x["name"]), F.coalesce(x["country"], F.lit(""))
        return F.ltrim(F.when((country != "") & ~F.contains(name, country), F.concat(name, F.lit(" ("), country, F.lit(")"))).otherwise(name))

    remote = F.coalesce(F.exists(i["locations"], lambda x: _is(x["workplaceType"], "remote")), F.lit(False))
    merged = rows.groupBy(i["id"].alias("id")).agg(
        F.min(F.struct(at.alias("at"), i["name"].alias("name"), i["url"].alias("url"), i["department"]["name"].alias("department"))).alias("first"),
        F.array_sort(F.collect_list(F.struct(at.alias("at"), F.transform(i["locations"], named).alias("names")))).alias("parts"),
        F.bool_or(remote).alias("remote"),
    )
    places = _joined(F.array_distinct(F.flatten(F.transform("parts", lambda p: F.coalesce(p["names"], F.array().cast("array<string>"))))), "; ")
    url = F.coalesce(F.nullif(F.col("first.url"), F.lit("")), F.concat(F.lit(site + "/jobs/"), F.col("id")))
    return _posting(merged, ext_id=F.col("id"), title=_clean(F.col("first.name")), location_raw=places, url=url, department=_clean(F.col("first.department")), is_remote=F.col("remote"))


SMARTRECRUITERS = "totalFound int, content array<struct<id: string, name: string, releasedDate: string, location: struct<city: string, region: string, country: string, fullLocation: string, remote: boolean>, department: struct<label: string>>>"
SECTIONS = ["companyDescription", "jobDescription", "qualifications", "additionalInformation"]
SMARTRECRUITERS_DETAIL = "ext_id string, postingUrl string, jobAd struct<sections: map<string, struct<title: string, text: string>>>"


def smartrecruiters(pages: DataFrame, site: str) -> DataFrame:
    p = F.col("p")
    rows = pages.select(F.explode("content").alias("p"))
    place = p["location"]
    full = F.coalesce(F.nullif(place["fullLocation"], F.lit("")), _joined(F.array(place["city"], place["region"], place["country"]), ", "))
    remote = F.coalesce(place["remote"], F.lit(False))
    return _posting(
        rows,
        ext_id=p["id"],
        title=_clean(p["name"]),
        location_raw=F.when(remote, F.concat(full, F.lit(" (Remote)"))).otherwise(full),
        url=F.concat(F.lit(site + "/"), p["id"]),
        department=p["department"]["label"],
        is_remote=remote,
        posted_at=_time(p["releasedDate"], None),
    )


def smartrecruiters_detail(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Listed postings with their sections in a fixed order."""
    rows = listed.join(details, "ext_id")
    parts = F.transform(F.array(*map(F.lit, SECTIONS)), lambda k: F.try_element_at(F.col("jobAd.sections"), k))
    made = F.array_join(F.transform(F.filter(parts, lambda s: F.coalesce(s["text"], F.lit("")) != ""), lambda s: F.concat(F.when(F.coalesce(s["title"], F.lit("")) != "", F.concat(F.lit("<h3>"), s["title"], F.lit("</h3>"))).otherwise(""), s["text"])), "")
    rows = rows.withColumn("_html", made).withColumn("_text", html_to_text("_html"))
    given = {c: F.col(c) for c in COLUMNS} | {"description_html": F.col("_html"), "description_text": F.col("_text"), "url": F.coalesce(F.nullif(F.col("postingUrl"), F.lit("")), F.col("url"))}
    return _posting(rows, **given)


WORKABLE = "jobs array<struct<title: string, shortcode: string, url: string, department: string, telecommuting: boolean, published_on: string, locations: array<struct<city: string, region: string, country: string, hidden: boolean>>>>"


def workable(pages: DataFrame, site: str) -> DataFrame:
    """Hidden locations are left out; a code is kept once; parts of a place that repeat the one before are dropped."""
    j = F.col("j")
    rows = pages.select(F.posexplode("jobs").alias("at", "j")).where(F.coalesce(j["shortcode"], F.lit("")) != "")
    rows = rows.groupBy(j["shortcode"].alias("code")).agg(F.min_by("j", "at").alias("j"))

    def place(x: Column) -> Column:
        parts = F.filter(F.array(x["city"], x["region"], x["country"]), lambda p: F.coalesce(p, F.lit("")) != "")
        return F.array_join(F.filter(parts, lambda p, i: (i == 0) | (p != F.try_element_at(parts, i))), ", ")

    shown = F.filter(F.coalesce(j["locations"], F.array().cast("array<struct<city: string, region: string, country: string, hidden: boolean>>")), lambda x: ~F.coalesce(x["hidden"], F.lit(False)))
    location = _joined(F.transform(shown, place), "; ")
    return _posting(
        rows,
        ext_id=F.col("code"),
        title=_clean(j["title"]),
        location_raw=location,
        url=F.coalesce(F.nullif(j["url"], F.lit("")), F.concat(F.lit(site + "/j/"), F.col("code"))),
        department=_clean(j["department"]),
        is_remote=F.coalesce(j["telecommuting"], F.lit(False)) | _says_remote(location),
        posted_at=_time(j["published_on"], "yyyy-MM-dd"),
    )


EIGHTFOLD = "count int, positions array<struct<id: bigint, name: string, location: string, locations: array<string>, department: string, t_create: bigint, work_location_option: string, canonicalPositionUrl: string, job_description: string>>"


def eightfold(pages: DataFrame) -> DataFrame:
    """Positions without an id are left out, repeated ones kept once."""
    p = F.col("p")
    rows = pages.select(F.explode("positions").alias("p")).where(F.coalesce(p["id"], F.lit(0)) != 0).dropDuplicates(["p"])
    rows = rows.groupBy(p["id"].alias("id")).agg(F.min("p").alias("p"))
    location = F.when(F.size(F.coalesce(p["locations"], F.array().cast("array<string>"))) > 0, F.array_join(p["locations"], "; ")).otherwise(F.coalesce(p["location"], F.lit("")))
    return _posting(
        rows.withColumn("_text", html_to_text(p["job_description"])),
        ext_id=F.col("id").cast("string"),
        title=_clean(p["name"]),
        location_raw=location,
        url=p["canonicalPositionUrl"],
        department=p["department"],
        description_html=p["job_description"],
        description_text=F.col("_text"),
        is_remote=_is(p["work_location_option"], "remote") | _says_remote(location),
        posted_at=F.when(p["t_create"] > 0, F.timestamp_seconds(p["t_create"])),
    )


AMAZON = "hits int, jobs array<struct<id_icims: string, title: string, location: string, normalized_location: string, job_category: string, job_path: string, posted_date: string, description: string, basic_qualifications: string, preferred_qualifications: string>>"


def amazon(pages: DataFrame, site: str) -> DataFrame:
    """"Virtual" means remote here; qualifications are sections of the text."""
    j = F.col("j")
    section = lambda head, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"<h3>{head}</h3><p>"), body, F.lit("</p>"))).otherwise("")
    rows = pages.select(F.explode("jobs").alias("j"))
    markup = F.concat(F.lit("<p>"), F.coalesce(j["description"], F.lit("")), F.lit("</p>"), section("Basic qualifications", j["basic_qualifications"]), section("Preferred qualifications", j["preferred_qualifications"]))
    rows = rows.withColumn("_html", markup).withColumn("_text", html_to_text("_html"))
    location = F.coalesce(F.nullif(j["normalized_location"], F.lit("")), j["location"], F.lit(""))
    remote = F.contains(F.lower(F.concat_ws(" ", location, j["title"])), F.lit("virtual")) | _says_remote(location)
    return _posting(
        rows,
        ext_id=j["id_icims"],
        title=_clean(j["title"]),
        location_raw=location,
        url=F.concat(F.lit(site), j["job_path"]),
        department=j["job_category"],
        description_html=F.col("_html"),
        description_text=F.col("_text"),
        is_remote=remote,
        posted_at=_time(j["posted_date"], "MMMM d, yyyy"),
    )


def _detailed(listed: DataFrame, details: DataFrame, title: Column, parts: list[Column], **given: Column) -> DataFrame:
    """Listed postings with the title and the filled parts of their details; other columns as listed unless given."""
    rows = listed.join(details, "ext_id")
    rows = rows.withColumn("_html", _joined(F.array(*[F.when(trimmed(p) != "", p) for p in parts]), "\n")).withColumn("_text", html_to_text("_html"))
    own = {c: F.col(c) for c in COLUMNS} | {"title": F.coalesce(F.nullif(_clean(title), F.lit("")), F.col("title")), "description_html": F.col("_html"), "description_text": F.col("_text")}
    return _posting(rows, **(own | given))


ORACLE_DETAIL = "ext_id string, items array<struct<Title: string, ExternalDescriptionStr: string, ExternalResponsibilitiesStr: string, ExternalQualificationsStr: string, ExternalPostedStartDate: string, WorkplaceTypeCode: string>>"


def oracle_detail(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Description, responsibilities and qualifications; postings whose page holds none are left out."""
    d = F.try_element_at("items", F.lit(1))
    remote = F.when(d["WorkplaceTypeCode"].eqNullSafe(F.lit("ORA_REMOTE")), True).otherwise(F.col("is_remote"))
    parts = [d["ExternalDescriptionStr"], d["ExternalResponsibilitiesStr"], d["ExternalQualificationsStr"]]
    return _detailed(listed, details.where(F.size("items") > 0), d["Title"], parts, is_remote=remote, posted_at=F.coalesce(_time(d["ExternalPostedStartDate"], None), F.col("posted_at")))


RIPPLING_DETAIL = "ext_id string, name string, description struct<company: string, role: string>, createdOn string"


def rippling_detail(listed: DataFrame, details: DataFrame) -> DataFrame:
    """The role, then the company."""
    return _detailed(listed, details, F.col("name"), [F.col("description.role"), F.col("description.company")], posted_at=F.coalesce(_time(F.col("createdOn"), None), F.col("posted_at")))


WORKABLE_DETAIL = "ext_id string, detail struct<title: string, description: string, requirements: string, benefits: string, workplace: string, remote: boolean>"


def workable_detail(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Description, requirements and benefits."""
    d = F.col("detail")
    remote = F.when(F.coalesce(d["remote"], F.lit(False)) | _is(d["workplace"], "remote"), True).otherwise(F.col("is_remote"))
    return _detailed(listed, details, d["title"], [d["description"], d["requirements"], d["benefits"]], is_remote=remote)


EIGHTFOLD_DETAIL = "ext_id string, job_description string"


def eightfold_detail(listed: DataFrame, details: DataFrame) -> DataFrame:
    """The description alone."""
    return _detailed(listed, details, F.col("title"), [F.col("job_description")])


@dataclass(frozen=True)
class Board:
    """A board system: the schema of its pages and its reader."""

    schema: str
    reader: object
    needs_site: bool = False


BOARDS = {
    "greenhouse": Board(GREENHOUSE, greenhouse),
    "lever": Board(LEVER, lever),
    "ashby": Board(ASHBY, ashby),
    "workday": Board(WORKDAY, workday, True),
    "oracle": Board(ORACLE, oracle, True),
    "rippling": Board(RIPPLING, rippling, True),
    "smartrecruiters": Board(SMARTRECRUITERS, smartrecruiters, True),
    "workable": Board(WORKABLE, workable, True),
    "eightfold": Board(EIGHTFOLD, eightfold),
    "amazon": Board(AMAZON, amazon, True),
}


def read_board(spark: SparkSession, ats: str, path: str, site: str = "") -> DataFrame:
    """The postings of a board's landed pages; a page that doesn't parse fails the read, since a hole would close postings."""
    if ats not in BOARDS:
        raise ValueError(f"unknown board system {ats!r}; known: {', '.join(sorted(BOARDS))}")
    board = BOARDS[ats]
    pages = spark.read.schema(board.schema).json(path, multiLine=True, mode="FAILFAST")
    return board.reader(pages, site) if board.needs_site else board.reader(pages)


HOSTS = {"boards.greenhouse.io": "greenhouse", "job-boards.greenhouse.io": "greenhouse", "jobs.lever.co": "lever", "jobs.ashbyhq.com": "ashby", "jobs.smartrecruiters.com": "smartrecruiters", "careers.smartrecruiters.com": "smartrecruiters", "apply.workable.com": "workable", "ats.rippling.com": "rippling"}


#: Hosts that name the account, language parts of a path, and how an account is spelled.
ORACLE_HOST = r"^([a-z0-9-]+\.fa(?:\.[a-z0-9-]+)?)\.oraclecloud\.com$"
WORKDAY_HOST = r"^([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com$"
WORKDAY_SITE = r"^(wd\d+)\.myworkdaysite\.com$"
LOCALE = "^[a-z]{2}-[A-Za-z]{2}$"
SLUG = "^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$"


def board_of_url(url: Column) -> Column:
    """Struct (ats, token) of the board that a posting's or board's URL is on; null for others.

    Most systems name the account in the path. Oracle's token is host/site, Workday's tenant.host/site, whichever of its
    two kinds of host it is.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^\s*https?://([^/?#:]+)", 1)), r"^www\.", "")
    parts = F.array_remove(F.split(F.regexp_extract(url, r"^\s*https?://[^/?#]*([^?#]*)", 1), "/"), "")
    part = lambda rest, i: F.coalesce(F.get(rest, F.lit(i)), F.lit(""))
    first = part(parts, 0)
    embedded = F.regexp_extract(url, r"[?&]for=([^&#]*)", 1)
    ats = F.coalesce(*[F.when(host == h, a) for h, a in HOSTS.items()])
    token = F.when((ats == "greenhouse") & (first == "embed"), embedded).when((ats == "workable") & first.isin("j", "api"), "").otherwise(first)
    token = F.when(ats.isin("ashby", "smartrecruiters"), token).otherwise(F.lower(token))
    board = lambda name, found: F.struct(F.lit(name).alias("ats"), found.alias("token"))

    followed = F.filter(parts, lambda p, i: (i > 0) & (F.get(parts, i - 1) == "sites") & p.rlike(SLUG))
    oracle_site = part(followed, 0)
    inner = F.when((F.size(parts) >= 4) & (first == "wday") & (part(parts, 1) == "cxs"), F.slice(parts, 4, 100)).when(first.rlike(LOCALE), F.slice(parts, 2, 100)).otherwise(parts)
    recruiting = F.when(first.rlike(LOCALE), F.slice(parts, 2, 100)).otherwise(parts)
    tenant, site = part(recruiting, 1), part(recruiting, 2)
    return (
        F.when(ats.isNotNull(), F.when(token.rlike(SLUG), F.struct(ats.alias("ats"), token.alias("token"))))
        .when(host.rlike(ORACLE_HOST), F.when(oracle_site != "", board("oracle", F.concat_ws("/", F.regexp_extract(host, ORACLE_HOST, 1), oracle_site))))
        .when(host.rlike(WORKDAY_HOST), F.when(part(inner, 0).rlike(SLUG), board("workday", F.concat(F.regexp_extract(host, WORKDAY_HOST, 1), F.lit("."), F.regexp_extract(host, WORKDAY_HOST, 2), F.lit("/"), part(inner, 0)))))
        .when(host.rlike(WORKDAY_SITE) & (part(recruiting, 0) == "recruiting") & tenant.rlike(SLUG) & site.rlike(SLUG), board("workday", F.concat(F.lower(tenant), F.lit("."), F.regexp_extract(host, WORKDAY_SITE, 1), F.lit("/"), site)))
    )
