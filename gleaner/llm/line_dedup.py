"""Line dedup with two Bloom filters.

Each document's distinct line hashes go through two filters: a hash that the first one (once seen) holds already enters
the second (twice seen). Lines that the second filter does not hold stand in one document and are done with. Those it
holds are suspected repeats; they alone are shuffled by their 128-bit digests, which confirms them exactly and chooses
the document that keeps them.

The filters are blocked: the upper bits of a hash name a block of four 64-bit words, its lower bits one bit in each of
them. Blocks grow with the lines (``BITS`` a line) and are dealt to shards by their number, so no task builds more than
its shards and nothing passes through the driver. Tasks send each hash once for some hundred thousand lines, with a mark
if it came again, so a line that stands everywhere is no more work than another one.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import cut

#: Code points of a line that counts, and documents that make it a repeat.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Bits of a filter for each line; words and bits of a block.
BITS, WORDS, BLOCK = 16, 4, 256
#: Blocks of a shard at most (8 MB a filter), and binary digits of the least number of shards.
SHARD_BLOCKS, SHARD_DIGITS = 1 << 18, 6
#: Hashes that a task gathers before it sends them.
HELD = 1 << 20
#: Bytes of the twice-seen filter up to which it is sent to every executor; beyond them lines go to their blocks.
BROADCAST = 32 << 20

#: White space between words.
BLANKS = " \t\n\x0b\x0c\r"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines as an array: white space stripped at both ends, A-Z lower-cased; null is one empty line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda x: F.translate(F.btrim(x, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase))


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """128 bits of what a row's result depends on."""
    return [F.xxhash64(F.lit(k), doc_id, doc_id.isNull(), text, text.isNull()) for k in (0, 1)]


def line_hashes(docs: DataFrame, doc_id: str, text: str, least_chars: int) -> DataFrame:
    """Rows (k1, k2, doc_id, pos, h, g): arrays of the places of a row's long lines and of their keys' digests."""
    keys = row_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    rows = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), F.col(f"`{doc_id}`").alias("doc_id"), line_keys(F.col(f"`{text}`")).alias("keys"))
    long = F.transform("keys", lambda k, i: F.when(F.length(k) >= least_chars, F.struct(i.alias("pos"), F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g"))))
    rows = rows.select("k1", "k2", "doc_id", F.filter(long, lambda x: x.isNotNull()).alias("lines"))
    return rows.select("k1", "k2", "doc_id", "lines.pos", "lines.h", "lines.g").where(F.size("h") > 0)


def twice_seen(hashes: DataFrame, digits: int) -> DataFrame:
    """Rows (block, w0, w1, w2, w3) of the twice-seen filter of 2^``digits`` blocks over the arrays h of ``hashes``, blocks without any hash left out."""
    shard_digits = min(digits, max(SHARD_DIGITS, digits - int(math.log2(SHARD_BLOCKS))))
    packets = hashes.select(F.array_distinct("h").alias("h")).mapInArrow(_packets(shard_digits), "shard long, hashes binary, again binary")
    words = ", ".join(f"w{i} long" for i in range(WORDS))
    return packets.groupBy("shard").applyInArrow(_filter_blocks(digits, shard_digits), f"block long, {words}")


def _packets(shard_digits: int):
    schema = pa.schema([("shard", pa.int64()), ("hashes", pa.binary()), ("again", pa.binary())])

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        shards = (hashes >> np.uint64(64 - shard_digits)).astype(np.int64)  # hashes are sorted, so shards are too
        begins = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
        ends = np.r_[begins[1:], len(hashes)]
        again = counts > 1
        return pa.record_batch([pa.array(shards[begins]), pa.array([hashes[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()), pa.array([again[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= HELD:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def _filter_blocks(digits: int, shard_digits: int):
    n = 1 << (digits - shard_digits)

    def blocks(key: tuple, packets: pa.Table) -> pa.Table:
        once, twice = np.zeros(n * WORDS, dtype=np.uint64), np.zeros(n * WORDS, dtype=np.uint64)
        for hashes, again in zip(packets["hashes"].to_pylist(), packets["again"].to_pylist(), strict=True):
            hashes, seen = np.frombuffer(hashes, dtype=np.uint64), np.frombuffer(again, dtype=bool).copy()
            at = ((hashes >> np.uint64(64 - digits)) & np.uint64(n - 1)).astype(np.int64) * WORDS
            bits = [np.uint64(1) << ((hashes >> np.uint64(6 * i)) & np.uint64(63)) for i in range(WORDS)]
            seen |= np.logical_and.reduce([(once[at + i] & bits[i]) != 0 for i in range(WORDS)])
            for i in range(WORDS):
                np.bitwise_or.at(once, at + i, bits[i])
                np.bitwise_or.at(twice, at[seen] + i, bits[i][seen])
        table = twice.reshape(n, WORDS).view(np.int64)
        full = np.flatnonzero((table != 0).all(axis=1))
        return pa.table({"block": full + (int(key[0].as_py()) << (digits - shard_digits)), **{f"w{i}": table[full, i] for i in range(WORDS)}})

    return blocks


def suspects(hashes: DataFrame, bits: int = BITS, broadcast: int = BROADCAST) -> DataFrame:
    """Rows (k1, k2, doc_id, pos, h, g) of the lines of ``hashes`` that the twice-seen filter holds."""
    lines = hashes.agg(F.sum(F.size("h"))).first()[0] or 0
    digits = max(SHARD_DIGITS, math.ceil(math.log2(max(1, lines * bits / BLOCK))))
    blocks = cut(twice_seen(hashes, digits))
    if blocks.count() * 8 * (1 + WORDS) <= broadcast:
        blocks = F.broadcast(blocks)
    rows = hashes.select("k1", "k2", "doc_id", F.explode(F.arrays_zip("pos", "h", "g")).alias("line")).select("k1", "k2", "doc_id", "line.*")
    held = " AND ".join(f"shiftrightunsigned(w{i}, CAST(shiftrightunsigned(h, {6 * i}) & 63 AS INT)) & 1 = 1" for i in range(WORDS))
    probed = rows.withColumn("block", F.shiftrightunsigned("h", 64 - digits)).join(blocks, "block").where(held)
    return probed.select("k1", "k2", "doc_id", "pos", "h", "g")


def repeats(suspected: DataFrame, least_docs: int) -> DataFrame:
    """Rows (h, g, keeper): the lines that ``least_docs`` documents hold, with the largest doc_id among these in a struct."""
    return suspected.select("h", "g", "doc_id").distinct().groupBy("h", "g").agg(F.count("*").alias("n"), F.max(F.struct("doc_id")).alias("keeper")).where(F.col("n") >= least_docs).drop("n")


def dropped_lines(docs: DataFrame, doc_id: str, text: str, least_chars: int, least_docs: int, bits: int, broadcast: int) -> DataFrame:
    """Rows (k1, k2, dropped): the places of the lines that each row loses, where it loses any.

    Joins are on complements of the keys: neither side comes dealt by these, so the adaptive skew join can split a line
    that stands in many documents.
    """
    suspected = cut(suspects(cut(line_hashes(docs, doc_id, text, least_chars)), bits, broadcast))
    chosen = repeats(suspected, least_docs).select(F.bitwise_not("h").alias("nh"), F.bitwise_not("g").alias("ng"), "keeper")
    lines = suspected.withColumns({"nh": F.bitwise_not("h"), "ng": F.bitwise_not("g")}).join(chosen, ["nh", "ng"])
    lost = lines.where(~F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")))
    return lost.groupBy("k1", "k2").agg(F.collect_set("pos").alias("dropped"))


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    """Texts without the lines at the places ``dropped``; null where there are none."""

    def kept(text, places):
        if places is None:
            return None
        gone = set(places.tolist())
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    return pd.Series([kept(*x) for x in zip(texts, dropped, strict=True)], dtype=object)


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bits: int = BITS, broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` with their texts less the lines that repeat across documents, and with n_lines and n_dropped.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of ``least_chars`` code
    points or more in ``least_docs`` documents or more lose all their lines but those of the largest doc_id that holds
    them, however often it does. Null and empty texts are one empty line and come out empty. Rows of one doc_id count as
    one document; a null doc_id is a document and comes before all others. Repeated rows are treated alike. Other
    columns pass through, whatever their names; n_lines (before dropping) and n_dropped replace columns of that name. An
    empty table gives no rows. Lines are told apart by 128 bits of their keys. Texts are shuffled once.
    """
    dropped = dropped_lines(docs, doc_id, text, least_chars, least_docs, bits, broadcast)
    keys = row_keys(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    packed = docs.select(F.bitwise_not(keys[0]).alias("_n1"), F.bitwise_not(keys[1]).alias("_n2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    lost = dropped.select(F.bitwise_not("k1").alias("_n1"), F.bitwise_not("k2").alias("_n2"), F.col("dropped").alias("_dropped"))
    joined = packed.join(lost, ["_n1", "_n2"], "left")
    old = {c: F.col("_doc").getField(c) for c in docs.columns}
    whole = F.coalesce(old[text], F.lit(""))
    new = old | {
        text: F.coalesce(_without(F.when(F.col("_dropped").isNotNull(), whole), "_dropped"), whole),
        "n_lines": (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long"),
        "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0)).cast("long"),
    }
    return joined.select(*[expression.alias(name) for name, expression in new.items()])


LINES_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeats AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, line, i, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN repeats USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
