"""Finding postings: by the address of a page, in newest-first listings, and by rules for what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import trimmed, url_key
from gleaner.operators.merge import stale_or_missing, upsert
from gleaner.operators.rules import Catalog, Preferences, apply_rules

#: Query parameters in which a company's own page names a board's posting, and what ends a path that does.
BOARD_PARAMETERS = {"gh_jid": "greenhouse", "ashby_jid": "ashby"}
TRAILING_ID = r"([0-9]{5,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})/?(?:apply|application)?/?$"
APPLY_SUFFIX = r"/(?:apply|application)(?:/.*)?$"


def found_by_url(pages: DataFrame, jobs: DataFrame, matches: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (page_id, user_id, job_id): the posting of the user that a page is about, if there is one.

    ``pages``: (page_id, user_id, url); ``jobs``: (id, url, source, ext_id, closed_at); ``matches``: (user_id, job_id).
    The ladder: the page's address, as it is or compared, or that of the posting above an application form; the
    board's posting that its query names; the id that ends its path, as a posting's own id or in its address. Of the
    postings of a rung open ones come first, then the smallest id. Every rung is an equality join: of addresses only
    the ids that end their paths are compared.
    """
    rtrim = lambda c: F.rtrim(c, F.lit("/"))
    key = url_key(F.col("_url"))
    asked = pages.select(F.col(page_id).alias("page_id"), "user_id", F.col(url).alias("_url")).withColumn("_key", F.coalesce(key, F.col("_url")))
    addresses = F.array_distinct(F.array(rtrim(F.col("_key")), rtrim(trimmed(F.col("_url"))), rtrim(F.regexp_replace(F.col("_key"), APPLY_SUFFIX, ""))))
    path = F.regexp_extract(F.col("_key"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    trailing = F.nullif(F.regexp_extract(path, TRAILING_ID, 1), F.lit(""))
    named = [F.struct(F.lit(source).alias("source"), F.nullif(F.regexp_extract(F.col("_key"), rf"[?&]{p}=([^&#]*)", 1), F.lit("")).alias("id")) for p, source in BOARD_PARAMETERS.items()]
    base = jobs.select(F.col("id").alias("job_id"), F.col("url").alias("job_url"), "source", "ext_id", F.col("closed_at").isNotNull().alias("closed"))
    by_address = asked.select("page_id", "user_id", F.explode(addresses).alias("address")).join(base.withColumn("address", rtrim(F.col("job_url"))), "address").withColumn("rung", F.lit(1))
    by_name = asked.select("page_id", "user_id", F.explode(F.array(*named)).alias("n")).select("page_id", "user_id", F.col("n.source").alias("source"), F.col("n.id").alias("ext_id")).join(base, ["source", "ext_id"]).withColumn("rung", F.lit(2))
    ends = asked.select("page_id", "user_id", trailing.alias("end")).where("end IS NOT NULL")
    job_path = F.regexp_extract(F.col("job_url"), r"^[^?#]*", 0)
    own = base.withColumn("end", F.explode(F.array_distinct(F.array_compact(F.array(F.col("ext_id"), F.nullif(F.regexp_extract(job_path, TRAILING_ID, 1), F.lit("")))))))
    by_end = ends.join(own, "end").withColumn("rung", F.lit(3))
    columns = ["page_id", "user_id", "job_id", "rung", "closed"]
    found = by_address.select(*columns).unionByName(by_name.select(*columns)).unionByName(by_end.select(*columns))
    best = F.min(F.struct("rung", "closed", "job_id"))["job_id"].alias("job_id")
    return found.join(matches.select("user_id", "job_id"), ["user_id", "job_id"], "left_semi").groupBy("page_id", "user_id").agg(best)


def newest_pages(listed: DataFrame, known: DataFrame, board: str = "board", page: str = "page", ext_id: str = "ext_id") -> DataFrame:
    """``listed`` rows of newest-first pages up to the first page without an unknown posting, each posting once, with complete.

    complete tells that a board's last page was reached, so that what it does not list is gone; the pages of a board
    that stopped before leave that open. ``known``: (board, ext_id).
    """
    first = Window.partitionBy(board, ext_id).orderBy(page)
    once = listed.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    fresh = once.join(known.select(board, ext_id), [board, ext_id], "left_anti").groupBy(board, page).agg(F.count("*").alias("_fresh"))
    pages = listed.groupBy(board, page).agg(F.lit(1).alias("_one")).join(fresh, [board, page], "left")
    stops = pages.groupBy(board).agg(F.min(F.when(F.col("_fresh").isNull(), F.col(page))).alias("_stop"), F.max(page).alias("_last"))
    kept = once.join(stops, board).where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop")))
    return kept.withColumn("complete", F.col("_stop").isNull() | (F.col("_stop") == F.col("_last"))).drop("_stop", "_last")


def modified(pages: DataFrame, stored: DataFrame, key: str = "board", etag: str = "etag") -> DataFrame:
    """The landed ``pages`` of boards whose tag is not the stored one; a board without a tag always counts as changed."""
    before = stored.select(key, F.col(etag).alias("_tag"))
    return pages.join(before, key, "left").where(F.col("_tag").isNull() | F.col(etag).isNull() | (F.col("_tag") != F.col(etag))).drop("_tag")


def filtered(postings: DataFrame, outcomes: DataFrame, prefs: Preferences, catalog: Catalog, version: str = "content_hash", key: str = "id") -> DataFrame:
    """The next ``outcomes`` of a user: rules run only on postings without an outcome of their current version.

    ``postings``: (key, version, title, location, description); ``outcomes``: (key, version, reason, ...). Columns of
    outcomes that rules do not set, such as the link to an analysis, stay.
    """
    fresh = apply_rules(stale_or_missing(postings, outcomes, [key], version), prefs, catalog)
    return upsert(outcomes, fresh.select(key, version, *[c for c in ("reason", "evidence", "categories", "flags") if c in outcomes.columns]), [key])
