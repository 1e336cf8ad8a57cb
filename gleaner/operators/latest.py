"""Latest-row, top-k and paging operators with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, which should be total."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def page(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """One page of ``rows``."""
    return rows.orderBy(*order).offset(offset).limit(size)


def page_size(asked: int, default: int = 50, ceiling: int = 200) -> int:
    """The page size for what a caller asked: the default for none, never above the ceiling."""
    return default if asked <= 0 else min(asked, ceiling)


def budget_cut(rows: DataFrame, keys: list[str], cost: str, budget, *order: Column) -> DataFrame:
    """Rows of each key taken in ``order`` while what was spent before them is under ``budget``."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("spent_before", F.coalesce(F.sum(cost).over(before), F.lit(0))).where(F.col("spent_before") < budget)


def nearest_rank(values, q: float):
    """Nearest-rank quantile of an array column: the sorted element at q * (n - 1), rounded half up; null for none."""
    at = F.floor(q * (F.size(values) - 1) + 0.5).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), at))


def nearest_ranks(rows: DataFrame, key: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """Rows (key, *wanted): each key's values at the nearest ranks of the shares ``wanted``, null for a key without values.

    Values are counted before they are ordered, so a key costs its different values and no list of them.
    """
    counted = rows.groupBy(key, value).agg(F.count(value).alias("_n"))
    order = Window.partitionBy(key).orderBy(F.col(value).asc_nulls_first())
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"_upto": upto, "_total": F.sum("_n").over(Window.partitionBy(key))})
    rank = lambda q: F.floor(F.lit(q) * (F.col("_total") - 1) + 0.5)
    at = lambda q: F.when((F.col("_upto") - F.col("_n") <= rank(q)) & (rank(q) < F.col("_upto")), F.col(value))
    return placed.groupBy(key).agg(*[F.max(at(q)).alias(name) for name, q in wanted.items()])
