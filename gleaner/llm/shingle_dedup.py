"""SimHash near-duplicates by word shingles of a Jaccard similarity of 0.8 or more: the pipeline's stage of operator 2.

Operator 2's Gray-order index over fingerprints of 5-word shingles proposes pairs that differ in few bits, and the
shingle sets decide. At a similarity of 0.8 about 10 of 64 bits differ, where no index keeps apart what is similar and
what is not at a bounded cost, so MinHash bands propose what the fingerprints leave out: sets of similarity 0.8 share
one of BANDS bands of ROWS minima but for a chance of (1 - 0.8 ** 5) ** 24 = 0.007 %, more similar ones but for less.

Documents with equal shingle sets are one class. Every class of a bucket is first compared with the smallest; the
classes of a bucket that are still in different groups then are compared with each other inside the tasks, in blocks
where they are many, so no pairs are written and all pairs of a bucket are verified or in one group already.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import cut
from gleaner.llm.components import connected_components, union
from gleaner.llm.simhash import fingerprint_links, majority, shingle_hashes

#: Words of a shingle, bands, minima of a band, and bits in which fingerprints of a pair that the index proposes differ.
SHINGLE, BANDS, ROWS, DISTANCE = 5, 24, 5, 4
#: Classes of a block of a large bucket: SMALL_BLOCK to LARGE_BLOCK, at most BLOCKS blocks while that allows.
SMALL_BLOCK, LARGE_BLOCK, BLOCKS = 512, 8192, 64
#: Sets of a block that are compared at once, and shingles that stand in its matrix at once.
SIDE, WIDTH = 256, 8192

_rng = np.random.default_rng(42)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set of shingle hashes, as signed longs; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 11):
        least = np.minimum(least, ((hashes[at : at + (1 << 11), None] ^ _FLIPS) * _FACTORS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


@F.pandas_udf(T.StructType([T.StructField("class", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
def _sketched(texts: pd.Series) -> pd.DataFrame:
    names, fps, bands = [], [], []
    for text in texts:
        hashes = shingle_hashes(text, SHINGLE)
        own = np.unique(hashes)
        names.append(xxhash.xxh64_intdigest(own.tobytes()))
        fps.append(majority(hashes))
        bands.append(sketch(own))
    return pd.DataFrame({"class": np.array(names, np.uint64).view(np.int64), "fp": np.array(fps, np.int64), "bands": bands})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([np.unique(shingle_hashes(t, SHINGLE)).view(np.int64) for t in texts])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sets have a similarity of 0.8 at least; sets move only to pairs whose sizes allow it."""
    sizes = [sets.select(F.col("class").alias(k), F.size("shingles").alias(f"n{k}")) for k in "ab"]
    near = pairs.distinct().join(sizes[0], "a").join(sizes[1], "b").where(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))
    left, right = (sets.select(F.col("class").alias(k), F.col("shingles").alias(f"x{k}")) for k in "ab")
    both = near.join(left, "a").join(right, "b")
    return both.where(9 * F.size(F.array_intersect("xa", "xb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """The matrix of how many elements each of ``xs`` shares with each of ``ys``; all are sorted sets."""
    if len(xs) == len(ys) == 1:
        return np.array([[len(np.intersect1d(xs[0], ys[0], assume_unique=True))]])
    x, y = np.concatenate(xs), np.concatenate(ys)
    shared = np.intersect1d(x, y)
    out = np.zeros((len(xs), len(ys)), np.float32)
    for at in range(0, len(shared), WIDTH):
        some = shared[at : at + WIDTH]
        sides = []
        for values, sets in ((x, xs), (y, ys)):
            place = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[place] == values
            side = np.zeros((len(sets), len(some)), np.float32)
            side[np.repeat(np.arange(len(sets)), list(map(len, sets)))[hit], place[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def bucket_links(rows: DataFrame) -> DataFrame:
    """Rows (a, b): links of a similarity of 0.8 that connect what any pair of different roots in a bucket links.

    ``rows``: (key, class, root, blocks, shingles), a bucket cut into ``blocks`` by hash; every two blocks are a group
    for one task, which gives a row for each of its members at most.
    """
    own = rows.withColumn("own", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "class", "root", "shingles")

    def solve(batch):
        classes, found = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
        second = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        column = batch.column(6)
        flat, ends = column.flatten().to_numpy(), np.append(0, np.cumsum(pa.compute.list_value_length(column).to_numpy()))
        sets = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        n = np.diff(ends)
        _, roots = np.unique(found, return_inverse=True)
        first = np.full(len(roots), len(batch))
        np.minimum.at(first, roots, np.arange(len(batch)))
        roots = first[roots]  # each member's first companion of the same root
        before = roots.copy()
        same = batch.column(1)[0].as_py() == batch.column(2)[0].as_py()
        p = np.arange(len(batch)) if same else np.flatnonzero(~second)
        q = p if same else np.flatnonzero(second)
        for at in range(0, len(p), SIDE):
            left = p[at : at + SIDE]
            for to in range(at if same else 0, len(q), SIDE):
                right = q[to : to + SIDE]
                if len(np.unique(np.concatenate((roots[left], roots[right])))) < 2:
                    continue
                shared = common_counts([sets[k] for k in left], [sets[k] for k in right])
                i, j = np.nonzero(9 * shared >= 4 * (n[left, None] + n[right]))
                union(roots, left[i], right[j])
        moved = np.flatnonzero(roots != before)
        return pa.RecordBatch.from_arrays([pa.array(classes[moved]), pa.array(classes[roots[moved]])], ["a", "b"])

    def compare(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            keys = [rest.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for start, end in zip([0, *change[:-1]], change, strict=False):
                yield solve(rest.slice(start, end - start))
            rest = rest.slice(change[-1] if len(change) else 0)
        if rest is not None and len(rest):
            yield solve(rest)

    order = ["key", "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long").distinct()


def shingle_links(proposed: DataFrame, buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified rows (a, b) that connect all classes which a chain of pairs of a similarity of 0.8 connects, pairs of
    ``proposed`` (a, b) or of one bucket (key, class)."""
    heads = buckets.groupBy("key").agg(F.min("class").alias("a"))
    led = buckets.join(heads, "key").where("class <> a").select("a", F.col("class").alias("b"))
    led = cut(_verified(led.unionByName(proposed), sets))
    # classes of one mark are linked through it already; a mark that has one of its own hands that on
    marks = led.select(F.greatest("a", "b").alias("class"), F.least("a", "b").alias("mark")).groupBy("class").agg(F.min("mark").alias("mark"))
    further = marks.select(F.col("class").alias("mark"), F.col("mark").alias("next"))
    marks = marks.join(further, "mark", "left").select("class", F.coalesce("next", "mark").alias("root"))
    rooted = cut(buckets.join(marks, "class", "left").withColumn("root", F.coalesce("root", "class")))
    members = rooted.groupBy("key").agg(
        F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("digest")
    )
    mixed = members.where("low < high").groupBy("n", "digest").agg(F.min("key").alias("key"))  # buckets of the same classes are one
    size = F.greatest(F.lit(SMALL_BLOCK), F.least(F.lit(LARGE_BLOCK), F.ceil(F.col("n") / BLOCKS)))
    mixed = mixed.select("key", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    rows = rooted.join(mixed, "key").join(sets, "class").select("key", "class", "root", "blocks", "shingles")
    return led.unionByName(cut(bucket_links(rows)))


def one_of_each_shingle_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with its columns, whatever their names.

    Documents link where their sets of 5-word shingles (ASCII lower case; all words where there are fewer) have a
    Jaccard similarity of 0.8 or more; null and empty texts are equal. Of a group the row with the smallest doc_id
    stays, rows without one last, by a digest of all columns where several have it; equal rows are one; an empty table
    gives no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    digest = [F.xxhash64(F.lit(i), *columns, *(c.isNull() for c in columns)).alias(n) for i, n in enumerate(("_h", "_g"))]
    own_id, own_text = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    keyed = docs.select(*digest, own_id.alias("doc_id"), own_text.alias("text"))
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h", "_g").alias("name")
    marked = cut(keyed.select(name, _sketched("text").alias("s")).select("name", "s.*"))
    reps = cut(marked.groupBy("class").agg(F.min("name").alias("name"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    heads = cut(reps.groupBy("fp").agg(F.min("class").alias("head"), F.count("*").alias("n")))
    near = fingerprint_links(heads, DISTANCE)
    ends = heads.select("fp", "head")
    proposed = near.join(ends.toDF("a", "ha"), "a").join(ends.toDF("b", "hb"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    alike = reps.join(heads.where("n > 1").drop("n"), "fp").where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    proposed = cut(proposed.unionByName(alike))
    buckets = reps.select("class", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = cut(buckets.join(shared, "key", "left_semi"))
    wanted = buckets.select("class").union(proposed.select("a")).union(proposed.select("b")).distinct()
    wanted = reps.join(wanted, "class", "left_semi").select("class", "name._h", "name._g")
    rows = keyed.select("_h", "_g", "text").join(wanted, ["_h", "_g"]).dropDuplicates(["_h", "_g"])  # a class has one name, and equal rows are one
    sets = cut(rows.select("class", _shingles("text").alias("shingles")))
    roots = connected_components(shingle_links(proposed, buckets, sets)).select(F.col("node").alias("class"), "root")
    kept = reps.join(roots, "class", "left").groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("name").alias("name"))
    kept = cut(kept.select("name._h", "name._g"))
    packed = docs.select(*digest, F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).alias("_doc"))
    single = packed.join(kept, ["_h", "_g"], "left_semi").dropDuplicates(["_h", "_g"])
    return single.select(*[F.col(f"_doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])
