"""Boards as a stream: a data source over landed pages whose offset is each board's ETag.

A fetcher lands what a board answers under ``<root>/<board>/<etag>/`` as one JSON file a page and then names the ETag in
``<root>/<board>/current``. A batch holds the pages of the boards whose ETag is another one than before; a board that did
not change gives nothing, and no page of it is opened. Each page is a partition. Pages of an ETag do not change once it
is named, so a batch that is run again reads the same rows. Files are read by Arrow's file systems, so ``root`` may be
a local path or a URI of a store that Arrow knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gleaner.sources.boards import BOARDS

FORMAT = "landed_boards"
PAGES = "board string, etag string, page string, body string"


@dataclass
class Page(InputPartition):
    board: str
    etag: str
    path: str


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def current_etags(root: str) -> dict[str, str]:
    """The named ETag of each landed board; a board that names none yet is left out."""
    store, path = _open(root)
    found = {}
    for entry in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if entry.type == fs.FileType.Directory and store.get_file_info(f"{entry.path}/current").type == fs.FileType.File:
            with store.open_input_stream(f"{entry.path}/current") as file:
                found[entry.base_name] = file.read().decode().strip()
    return found


def pages(root: str, etags: dict[str, str]) -> list[Page]:
    """The landed pages of boards at their ETags, in order."""
    store, path = _open(root)
    found = []
    for board, etag in sorted(etags.items()):
        listed = store.get_file_info(fs.FileSelector(f"{path}/{board}/{etag}"))
        found += [Page(board, etag, f.path) for f in sorted(listed, key=lambda f: f.path) if f.path.endswith(".json")]
    return found


def _rows(root: str, page: Page) -> Iterator[tuple]:
    store, _ = _open(root)
    with store.open_input_stream(page.path) as file:
        yield page.board, page.etag, page.path.rsplit("/", 1)[-1], file.read().decode()


class _Batch(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Page]:
        return pages(self.root, current_etags(self.root))

    def read(self, partition: Page | None) -> Iterator[tuple]:
        return _rows(self.root, partition) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        return current_etags(self.root)

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return pages(self.root, {board: etag for board, etag in end.items() if start.get(board) != etag})

    def read(self, partition: Page) -> Iterator[tuple]:
        return _rows(self.root, partition)

    def commit(self, end: dict) -> None:
        pass


class LandedBoards(DataSource):
    """``spark.read`` gives the pages of all boards as they are now, ``spark.readStream`` those that changed; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def landed(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """Rows (board, etag, page, body) of the landed boards, as a table or as a stream of what changed."""
    spark.dataSource.register(LandedBoards)
    reader = spark.readStream if stream else spark.read
    return reader.format(FORMAT).option("path", root).load()


def board_listings(landed_pages: DataFrame, ats: str, board: str, listed_at: Column, site: str = "") -> DataFrame:
    """Postings of one board's landed pages, as a table or a stream, as listings for the posting stream.

    Columns: source (``ats``/``board``), ext_id, title, location_raw, url, description_text, content_hash, listed_at and
    complete, which is true: what a board's pages lack was taken down. A page that is no JSON of the system's shape fails
    the read, since a hole would close postings.
    """
    system = BOARDS[ats]
    parsed = landed_pages.where(F.col("board") == board).select(F.from_json("body", system.schema, {"mode": "FAILFAST"}).alias("j")).select("j.*")
    rows = system.reader(parsed, site) if system.needs_site else system.reader(parsed)
    digest = F.xxhash64("title", "location_raw", "url", "description_text")
    return rows.select(F.lit(f"{ats}/{board}").alias("source"), "ext_id", "title", "location_raw", "url", "description_text", digest.alias("content_hash"), listed_at.alias("listed_at"), F.lit(True).alias("complete"))


def land(root: str, board: str, etag: str, bodies: list[dict]) -> None:
    """Land the pages of a board, and name their ETag once all of them are there."""
    store, path = _open(root)
    store.create_dir(f"{path}/{board}/{etag}", recursive=True)
    for i, body in enumerate(bodies):
        with store.open_output_stream(f"{path}/{board}/{etag}/{i:06d}.json") as file:
            file.write(json.dumps(body).encode())
    with store.open_output_stream(f"{path}/{board}/current.tmp") as file:
        file.write(etag.encode())
    store.move(f"{path}/{board}/current.tmp", f"{path}/{board}/current")
