"""Joins on keys of which one may hold very many rows, and cuts of lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def met(left: DataFrame, right: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each value of ``columns``, of which one may hold very many rows of ``left``.

    Both are dealt by a hash that stands for this join alone, so that the adaptive skew join can split such a value.
    """
    deal = F.xxhash64(F.lit("deal"), *columns).alias("_deal")
    return left.select("*", deal).join(right.select("*", deal), ["_deal", *columns], how).drop("_deal")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt over the tasks by a key that no two of them need share.

    For small rows with much work each: a file of them may be one task to read, whatever the number of cores.
    """
    return rows.repartition(F.xxhash64(F.lit("spread"), key))


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that what is read more than once is computed once.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one stands in for it in local mode only.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gleaner-checkpoint-"))
    return df.checkpoint(eager=True)
