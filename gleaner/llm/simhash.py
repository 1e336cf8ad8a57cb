"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint is the bitwise majority of the hashes of its word shingles. Fingerprints of which at most
``distance`` bits differ are linked. By the pigeonhole principle, two such fingerprints agree on ``blocks - distance``
of ``blocks`` bit blocks, so every choice of that many blocks is one table in which linked fingerprints share a key.
In a table the fingerprints of a key stand in Gray order and form a tree: a node keeps the bits that all fingerprints
below it share (mask and pattern), and a pair of nodes is dropped with everything below it as soon as the shared bits
alone differ in more than ``distance`` places.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import cut
from gleaner.llm.components import connected_components, union

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
TOP = np.uint64(1 << 63)
#: Fingerprints of one key that one task compares; keys with more go through midpoints().
DENSE = 4096
#: Children of a node, and the longest run of a key that is compared without a tree.
FAN, SHORT = 16, 48


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a text, one for each place; all words make one where they are fewer."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    parts = map(joined.__getitem__, map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(words) - k + 1)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit fingerprint of a text, as a signed long; 0 where it has no words."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the ``hashes``, as a signed long; 0 without hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """``docs`` with a column ``fp``; a null text counts as empty and gets 0."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn("fp", of(F.col(text)))


class Tables:
    """The bit permutations of the pigeonhole tables: each brings its chosen blocks to the top."""

    def __init__(self, distance: int, blocks: int):
        self.distance = distance
        cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        self.orders = []
        for chosen in combinations(range(blocks), blocks - distance):
            order = [spans[i] for i in chosen] + [s for i, s in enumerate(spans) if i not in chosen]
            self.orders.append((order, sum(spans[i][1] - spans[i][0] for i in chosen)))

    def ranks(self, fps: np.ndarray, t: int) -> np.ndarray:
        """Gray rank of each permuted fingerprint; its top bits stand for the key alone."""
        out = np.zeros(len(fps), np.uint64)
        for low, high in self.orders[t][0]:
            width = np.uint64(high - low)
            out = (out << width) | ((fps >> np.uint64(low)) & ((np.uint64(1) << width) - np.uint64(1)))
        for shift in (1, 2, 4, 8, 16, 32):
            out ^= out >> np.uint64(shift)
        return out

    def back(self, ranks: np.ndarray, t: int) -> np.ndarray:
        bits = ranks ^ (ranks >> np.uint64(1))
        out = np.zeros(len(ranks), np.uint64)
        for low, high in reversed(self.orders[t][0]):
            width = np.uint64(high - low)
            out |= (bits & ((np.uint64(1) << width) - np.uint64(1))) << np.uint64(low)
            bits = bits >> width
        return out

    def keys(self, ranks: np.ndarray, t: int) -> np.ndarray:
        return ranks >> np.uint64(64 - self.orders[t][1])


def tree_links(x: np.ndarray, distance: int):
    """Yield index pairs (i, j) of the Gray-sorted fingerprints ``x`` that differ in at most ``distance`` bits."""
    levels = [(np.full(len(x), ~np.uint64(0)), x)]
    while len(levels[-1][0]) > FAN:
        masks, bits = levels[-1]
        heads = np.arange(0, len(bits), FAN)
        first = np.repeat(bits[heads], FAN)[: len(bits)]
        shared = np.bitwise_and.reduceat(masks & ~(bits ^ first), heads)
        levels.append((shared, bits[heads] & shared))
    i, j = np.triu_indices(len(levels[-1][0]))
    todo = [(len(levels) - 1, i, j)]
    while todo:
        level, i, j = todo.pop()
        masks, bits = levels[level]
        near = np.bitwise_count((bits[i] ^ bits[j]) & masks[i] & masks[j]) <= distance
        i, j = i[near], j[near]
        if not level:
            yield i[i != j], j[i != j]
            continue
        below = len(levels[level - 1][0])
        for at in range(0, len(i), 4096):  # bounds what stands in memory
            p = (i[at : at + 4096, None, None] * FAN + np.arange(FAN)[None, :, None]).repeat(FAN, 2).ravel()
            q = (j[at : at + 4096, None, None] * FAN + np.arange(FAN)[None, None, :]).repeat(FAN, 1).ravel()
            good = (p <= q) & (q < below)
            todo.append((level - 1, p[good], q[good]))


def _stars(fps: np.ndarray, key: np.ndarray, distance: int):
    """Links (a, b) that join what is linked in the runs of equal ``key``; at most one for each fingerprint."""
    n = len(fps)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(starts[1:], n)
    sizes, roots = ends - starts, np.arange(n)
    end = np.repeat(ends, sizes)
    at, step = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT), sizes)), 1
    while len(at):
        at = at[at + step < end[at]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= distance]
        union(roots, near, near + step)
        step += 1
    for s, e in zip(starts[sizes > SHORT], ends[sizes > SHORT], strict=True):
        for i, j in tree_links(fps[s:e], distance):
            union(roots, i + s, j + s)
    moved = np.flatnonzero(roots != np.arange(n))
    return fps[moved], fps[roots[moved]]


def fingerprint_links(reps: DataFrame, distance: int = 4, blocks: int | None = None, dense: int = DENSE) -> DataFrame:
    """Rows (a, b) that connect exactly the distinct fingerprints of column ``fp`` linked by chains of small distances.

    Every task gives a spanning forest of its keys, so the rows grow with the fingerprints and not with their pairs.
    Keys with more than ``dense`` fingerprints pass their task unread into midpoints(), which is exact too.
    ``blocks`` sets the tables (default: from the number of rows, so that a key holds few unrelated fingerprints).
    """
    if blocks is None:
        n = reps.count()
        blocks = distance + 2 if n < 1 << 23 else distance + 3 if n < 1 << 28 else distance + 4
    tables = Tables(distance, blocks)

    def spread(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t in range(len(tables.orders)):
                ranks = tables.ranks(fps, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fps), t, np.int16)), pa.array(tables.keys(ranks, t).view(np.int64)), pa.array((ranks ^ TOP).view(np.int64))], ["t", "key", "rank"]
                )

    def solved(t, ranks, long):
        fps = tables.back(ranks, t)
        if long:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), t, np.int16)), pa.array(fps.view(np.int64)), pa.array(fps.view(np.int64))], ["t", "a", "b"])
        bits = ranks ^ (ranks >> np.uint64(1))
        x, y = _stars(bits, tables.keys(ranks, t), distance)
        out = [tables.back(_rank(z), t).view(np.int64) for z in (x, y)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), -1, np.int16)), pa.array(out[0]), pa.array(out[1])], ["t", "a", "b"])

    def linked(batches):
        rest, last, passing = np.zeros(0, np.uint64), None, None
        for batch in batches:
            ts = batch.column(0).to_numpy(zero_copy_only=False)
            ranks = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64) ^ TOP
            for t in np.unique(ts).tolist():
                if last is not None and t != last:
                    if len(rest):
                        yield solved(last, rest, passing is not None)
                    rest, passing = rest[:0], None
                last = t
                rest = np.concatenate((rest, ranks[ts == t]))
                while len(rest):
                    keys = tables.keys(rest, t)
                    if passing is not None and keys[0] != passing:
                        passing = None
                    head = int(np.searchsorted(keys, keys[0], "right"))
                    if head > dense or passing is not None:
                        yield solved(t, rest[:head], True)
                        passing, rest = keys[0], rest[head:]
                        continue
                    sizes_end = int(np.searchsorted(keys, keys[-1], "left"))
                    runs = np.diff(np.append(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), len(keys)))
                    long = np.flatnonzero(runs[:-1] > dense)
                    stop = int(runs[: long[0]].sum()) if len(long) else sizes_end
                    if not stop:
                        break
                    yield solved(t, rest[:stop], False)
                    rest = rest[stop:]
        if len(rest):
            yield solved(last, rest, passing is not None)

    rows = (
        reps.select("fp")
        .mapInArrow(spread, "t short, key long, rank long")
        .repartition("t", "key")
        .sortWithinPartitions("t", "rank")
        .mapInArrow(linked, "t short, a long, b long")
    )
    rows = cut(rows.distinct())
    packed = rows.where("t >= 0")
    links = rows.where("t < 0").select("a", "b")
    return links.unionByName(midpoints(packed.select("t", F.col("a").alias("fp")), tables)) if packed.head(1) else links


def midpoints(packed: DataFrame, tables: Tables) -> DataFrame:
    """Exact links of keys that hold very many fingerprints, without comparing them in pairs.

    Two fingerprints of a key differ in at most ``distance`` bits if and only if some word is within half of it of
    both; each fingerprint is dealt to all such words, and those that meet in a word are linked to its smallest.
    """
    half = tables.distance // 2
    if tables.distance % 2:
        raise ValueError("midpoints need an even distance")

    def deal(batches):
        for batch in batches:
            ts = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for t in np.unique(ts).tolist():
                order, width = tables.orders[t]
                free, taken = [], 0
                for low, high in order:
                    if taken >= width:
                        free += range(low, high)
                    taken += high - low
                flips = np.array([sum(1 << b for b in c) for k in range(half + 1) for c in combinations(free, k)], np.uint64)
                own = fps[ts == t]
                for at in range(0, len(own), 64):
                    some = own[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((some[:, None] ^ flips).ravel().view(np.int64)), pa.array(some.repeat(len(flips)).view(np.int64))], ["word", "fp"]
                    )

    dealt = packed.mapInArrow(deal, "word long, fp long")
    met = dealt.groupBy("word").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").drop("most")
    return dealt.join(met, "word").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def _rank(bits: np.ndarray) -> np.ndarray:
    out = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4, blocks: int | None = None, dense: int = DENSE) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of ``docs``.

    component_id is the smallest doc_id that chains of links reach, the row's own included. Null and empty texts have
    fingerprint 0 and are linked like any other; rows with a null doc_id take part and never name a component unless
    all of it is null; repeated rows give repeated rows; other columns are not read; an empty table gives no rows.
    """
    marked = cut(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle).select("doc_id", "fp"))
    reps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = fingerprint_links(reps, distance, blocks, dense)
    roots = connected_components(links).select(F.col("node").alias("fp"), "root")
    rooted = reps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id")).select(F.bitwise_not("root").alias("key"), "component_id")
    # the complement as key: both sides are shuffled for this join alone, so that a large group can be split
    named = rooted.withColumn("key", F.bitwise_not("root")).join(names, "key").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
