"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words, as Java and Python regular expressions read it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``; only in local mode, and only where that is unset, a temporary
    one is made. On a cluster a machine's own folder would be of no use to the others, so that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gleaner-checkpoint-"))
    return df.checkpoint(eager=True)


def words(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def with_runs(df: DataFrame, name: str, k: int) -> DataFrame:
    """``df`` with the array of longs ``name`` replaced by the 64-bit hashes of its runs of ``k`` elements (a power of two, or 3).

    Shorter arrays have none. Each step is a projection of its own: nested in one expression, Spark would compute the
    arrays of a step anew wherever the next one reads them.
    """
    if k == 3:
        both = df.withColumn("_pairs", _paired(F.col(name), F.col(name), 1))
        return both.withColumn(name, _paired(F.col("_pairs"), F.col(name), 2)).drop("_pairs")
    step = 1
    while step < k:
        df = df.withColumn(name, _paired(F.col(name), F.col(name), step))
        step *= 2
    return df


def _paired(left, right, step: int):
    """Hash of each element of ``left`` with the one ``step`` further on in ``right``."""
    return F.filter(F.zip_with(left, F.slice(right, step + 1, F.size(right)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))), lambda x: x.isNotNull())


def word_count(text):
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text column, 0 for null."""
    return F.size(words(text)).cast("long")
