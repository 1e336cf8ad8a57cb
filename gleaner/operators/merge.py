"""Upsert and lifecycle of keyed tables, as joins that give the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, staged: DataFrame, keys: list[str], values: dict[str, Column] | None = None) -> DataFrame:
    """The next version of ``target``: staged rows replace those of the same key, others are kept or added.

    ``values`` overrides columns of matched rows; its expressions read old values as ``old.x`` and new ones as
    ``new.x``. Keys must be unique on both sides; null keys match each other.
    """
    old, new = target.alias("old"), staged.withColumn("_staged", F.lit(True)).alias("new")
    match = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    joined = old.withColumn("_kept", F.lit(True)).alias("old").join(new, match, "full_outer")
    both, only_old = F.col("old._kept") & F.col("new._staged"), F.col("new._staged").isNull()
    out = []
    for c in target.columns:
        fresh = F.col(f"new.{c}") if c in staged.columns else F.col(f"old.{c}")
        if values and c in values:
            fresh = F.when(both, values[c]).otherwise(fresh)
        out.append(F.when(only_old, F.col(f"old.{c}")).otherwise(fresh).alias(c))
    return joined.select(*out)


def classify(stored: DataFrame, listed: DataFrame, keys: list[str], digest: str = "content_hash", closed: str = "closed_at") -> DataFrame:
    """Rows (*keys, change): new, changed, unchanged, reopened or missing, from a stored table and a full listing."""
    old = stored.select(*keys, F.col(digest).alias("_old"), F.col(closed).isNotNull().alias("_closed"), F.lit(True).alias("_stored"))
    new = listed.select(*keys, F.col(digest).alias("_new"), F.lit(True).alias("_listed"))
    both = old.join(new, keys, "full_outer")
    change = (
        F.when(F.col("_stored").isNull(), "new")
        .when(F.col("_listed").isNull(), "missing")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
        .when(F.col("_closed"), "reopened")
        .otherwise("unchanged")
    )
    return both.select(*keys, change.alias("change"))


def save_listing(stored: DataFrame, listed: DataFrame, now: Column, complete: Column | bool = True, keys: tuple[str, ...] = ("source", "ext_id"), manual: str = "manual") -> DataFrame:
    """The next version of a posting table after one listing.

    Listed rows are added or rewritten, or only touched where their digest is the same; they are open again. Stored
    rows that a complete listing of their source lacks are closed, but never manual ones, and never by a partial
    listing.
    """
    keys = list(keys)
    content = [c for c in listed.columns if c not in keys]
    old, new = stored.alias("old"), listed.withColumn("_listed", F.lit(True)).alias("new")
    joined = old.withColumn("_stored", F.lit(True)).alias("old").join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full_outer")
    is_listed, is_stored = F.col("new._listed").isNotNull(), F.col("old._stored").isNotNull()
    changed = is_listed & (~is_stored | ~F.col("old.content_hash").eqNullSafe(F.col("new.content_hash")))
    gone = ~is_listed & F.col("old.closed_at").isNull() & (F.col("old.source") != manual) & (complete if isinstance(complete, Column) else F.lit(complete))
    out = [F.coalesce(F.col(f"new.{k}"), F.col(f"old.{k}")).alias(k) for k in keys]
    for c in stored.columns:
        if c in keys:
            continue
        if c == "first_seen_at":
            value = F.when(is_stored, F.col("old.first_seen_at")).otherwise(now)
        elif c == "last_seen_at":
            value = F.when(is_listed, now).otherwise(F.col("old.last_seen_at"))
        elif c == "closed_at":
            value = F.when(is_listed, F.lit(None)).when(gone, now).otherwise(F.col("old.closed_at"))
        elif c in content:
            value = F.when(changed, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        else:
            value = F.col(f"old.{c}")
        out.append(value.alias(c))
    return joined.select(*out)


def stale_or_missing(rows: DataFrame, derived: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows without a derived row of the same key and version."""
    known = derived.select(*keys, F.col(version).alias("_version"), F.lit(True).alias("_known"))
    return rows.join(known, keys, "left").where(F.col("_known").isNull() | ~F.col("_version").eqNullSafe(F.col(version))).drop("_version", "_known")


def insert_absent(target: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the staged rows whose key it lacks."""
    return target.unionByName(staged.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*target.columns))
