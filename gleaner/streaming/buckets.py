"""A keyed table in buckets: a merge rewrites the buckets that it touches and commits by a new manifest.

The manifest of a version lists the files of each bucket. A merge reads the buckets of its staged rows, writes their next
state to new files, and then renames a manifest into place that keeps all other buckets' files as they are. Readers open
the newest manifest, so they see whole versions only, and a merge that fails before the rename leaves none of its rows
visible. One writer at a time. Files go through the Hadoop file system of the path, so any store that Spark writes will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column that names a row's bucket in the files.
BUCKET = "_bucket"


class BucketTable:
    """Rows of ``schema`` under ``path``, dealt to ``buckets`` by a hash of ``keys``.

    A bucket is named by the parts that ``keys`` have: with (("source", 16), ("ext_id", 64)) the rows of one source stand
    in 64 buckets of its own or of a few sources. The number of buckets stays as it is for a table's life.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[tuple[str, int], ...]):
        self.spark, self.path, self.schema, self.keys = spark, path, spark.createDataFrame([], schema).schema, keys
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self, parts: int | None = None):
        """The bucket of a row as a column, by the first ``parts`` keys alone if given."""
        found = F.lit(0).cast("long")
        for name, n in self.keys[:parts]:
            found = found * n + F.pmod(F.xxhash64(F.lit("bucket"), name), F.lit(n))
        return found

    def version(self) -> int:
        """The newest version; -1 for a table that was never written."""
        folder = self._hadoop.Path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return -1
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=-1)

    def manifest(self, version: int) -> dict[str, list[str]]:
        """Files of each bucket, relative to the table; none for a negative version."""
        if version < 0:
            return {}
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/manifests/{version}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default; of some buckets only, if given."""
        manifest = self.manifest(self.version() if version is None else version)
        files = [f"{self.path}/{f}" for b, found in manifest.items() if buckets is None or int(b) in buckets for f in found]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def merge(self, staged: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None, parts: int | None = None) -> int:
        """Write ``change(stored, staged)`` for the buckets that ``staged`` touches as the next version, and return that.

        ``stored`` holds all rows of these buckets, and the result must not leave them. ``parts`` names how many keys a
        touched bucket shares with a staged row: with 1 of (source, ext_id), all buckets of the staged sources. A
        ``version`` that exists already was committed before and is not written again, so a repeated batch counts once.
        The buckets' numbers, no rows, come to the driver.
        """
        last = self.version()
        target = last + 1 if version is None else version
        if target <= last:
            return last
        width = 1
        for _, n in self.keys[parts or len(self.keys) :]:
            width *= n
        heads = [r[0] for r in staged.select(self.bucket(parts)).distinct().collect()]
        touched = {h * width + i for h in heads for i in range(width)}
        rows = change(self.read(last, touched), staged).select(*self.schema.names)
        name = f"data/{target}-{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        manifest = {b: files for b, files in self.manifest(last).items() if int(b) not in touched}
        written = self._files(name)
        if strange := {int(b) for b in written} - touched:
            raise ValueError(f"rows of buckets that no staged row touches: {sorted(strange)[:5]}")
        self._commit(manifest | written, target)
        return target

    def rewrite(self, rows: DataFrame) -> int:
        """Replace all rows by ``rows`` as the next version."""
        target, name = self.version() + 1, f"data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        self._commit(self._files(name), target)
        return target

    def expire(self, keep: int = 2) -> int:
        """Remove all but the newest ``keep`` versions and the files that none of these reads; returns how many files went."""
        last = self.version()
        alive = {f for v in range(max(0, last - keep + 1), last + 1) if self._fs.exists(self._manifest_path(v)) for files in self.manifest(v).values() for f in files}
        gone = 0
        for run in self._fs.listStatus(self._hadoop.Path(f"{self.path}/data")) if last >= 0 else []:
            run_name = f"data/{run.getPath().getName()}"
            for files in self._files(run_name).values():
                for f in set(files) - alive:
                    gone += self._fs.delete(self._hadoop.Path(f"{self.path}/{f}"), False)
            if not self._files(run_name):
                self._fs.delete(run.getPath(), True)
        for v in range(max(0, last - keep + 1)):
            self._fs.delete(self._manifest_path(v), False)
        return gone

    def _manifest_path(self, version: int):
        return self._hadoop.Path(f"{self.path}/manifests/{version}.json")

    def _files(self, name: str) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for folder in self._fs.listStatus(self._hadoop.Path(f"{self.path}/{name}")):
            part = folder.getPath().getName()
            if part.startswith(f"{BUCKET}="):
                files = [f.getPath().getName() for f in self._fs.listStatus(folder.getPath())]
                if files := sorted(f"{name}/{part}/{f}" for f in files if f.endswith(".parquet")):
                    found[part.removeprefix(f"{BUCKET}=")] = files
        return found

    def _commit(self, manifest: dict, version: int) -> None:
        draft = self._hadoop.Path(f"{self.path}/manifests/.{version}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(self._manifest_path(version)) or not self._fs.rename(draft, self._manifest_path(version)):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was written by someone else")


def posting_table(spark: SparkSession, path: str, schema: str | T.StructType) -> BucketTable:
    """A posting table by (source, ext_id)."""
    return BucketTable(spark, path, schema, (("source", 16), ("ext_id", 16)))
