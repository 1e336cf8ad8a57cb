"""Pages of a sorted result that is computed once a version and then read a page at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.joins import materialized

#: Rows of a stored stretch; a page reads the stretches that it touches.
STRETCH = 10_000
ROW = "_row"


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in ``order`` with the row's number, from 0.

    Rows are sorted by range, so every partition knows its rows' places in itself; what stands before a partition is a
    prefix sum over the partitions' counts, one row each. ``order`` should leave no ties, else their order is any.
    """
    placed = materialized(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))  # a row a partition
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(ROW, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before")


class PagedResult:
    """A sorted result under ``folder``, kept by version.

    ``build`` makes the rows of a version and is called only where that version is not stored yet: a caller that asks
    again with the same version reads what is there. Stretches of ``stretch`` rows are folders of their own, so a page
    opens those that it touches and no others. Old versions are the caller's to remove.
    """

    def __init__(self, spark: SparkSession, folder: str, build: Callable[[], DataFrame], order: list[Column], stretch: int = STRETCH):
        self.spark, self.folder, self.build, self.order, self.stretch = spark, folder, build, order, stretch

    def _stored(self, version: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{version}/whole/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def rows(self, version: str) -> DataFrame:
        """All rows of a version with their numbers and stretches, stored first if need be."""
        path = f"{self.folder}/{version}"
        if not self._stored(version):
            made = numbered(self.build(), self.order).withColumn("_stretch", F.floor(F.col(ROW) / self.stretch))
            made.repartition("_stretch").write.mode("overwrite").partitionBy("_stretch").parquet(f"{path}/rows")
            made.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
            self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/whole")
        schema = self.spark.read.parquet(f"{path}/schema").schema
        return self.spark.read.schema(schema).parquet(f"{path}/rows")

    def touched(self, version: str, number: int, size: int) -> DataFrame:
        """The page's rows as they are read, out of the stretches that it touches."""
        first, rows = number * size, self.rows(version)
        near = F.col("_stretch").between(first // self.stretch, (first + size - 1) // self.stretch)
        return rows.where(near & (F.col(ROW) >= first) & (F.col(ROW) < first + size)).drop("_stretch")

    def page(self, version: str, number: int, size: int) -> DataFrame:
        """Rows number * size and on, ``size`` at most, in order; none past the end."""
        return self.touched(version, number, size).orderBy(ROW).drop(ROW)
