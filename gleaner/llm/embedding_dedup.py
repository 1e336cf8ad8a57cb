"""Embedding near-duplicates by sorted projection passes.

In each pass a vector's hash is the signs of its products with random directions, one bit after the other; vectors are
range-partitioned and sorted by it, and each is compared with the next ``window`` vectors of its label. Pairs that
pass an exact cosine check are united over all passes. How many passes it takes depends on how the vectors lie: those
that share a direction crowd under few hashes. So passes go on, a round of them at a time, until a round joins hardly
anything that was not joined before. What a bounded window leaves out of a dense group is made up for afterwards: the
vectors of each component are compared with each other in blocks, so every link inside a component is counted, whatever
its size. Equal vectors are one class with a weight, and no list of pairs is ever written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut
from gleaner.llm.components import connected_components, union

COSINE, WINDOW, BITS, SEED = 0.93, 48, 40, 42
#: Share of lone pairs at the threshold that the first passes may miss by the model of evenly spread vectors, and share
#: of all joins that a further round of passes may add and be the last one. Their number has no ceiling.
MISS = 0.002
#: Rows of a block of a large component: SMALL_BLOCK to LARGE_BLOCK, at most BLOCKS blocks while that allows.
SMALL_BLOCK, LARGE_BLOCK, BLOCKS = 32, 16384, 64


def passes_for(n: int, cosine: float = COSINE, window: int = WINDOW) -> int:
    """Passes after which a lone pair at the threshold among ``n`` evenly spread vectors of a label is missed with a chance of MISS."""
    agree = 1 - math.acos(cosine) / math.pi
    found = agree ** max(1.0, math.log2(max(2, n) / window))
    return max(8, math.ceil(math.log(MISS) / math.log(1 - found)))


def _matrix(column) -> np.ndarray:
    """Unit vectors, in double precision, of an Arrow list column whose lists are all of one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of large components would overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keyed_vectors(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, embedding) with h and g: two hashes of label and vector, null where it can link with nothing."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    return rows.withColumns({n: F.when(valid, F.xxhash64(F.lit(k), "label", F.size("embedding"), "embedding")) for k, n in enumerate("hg")})


def vector_classes(rows: DataFrame) -> DataFrame:
    """Rows (class, h, g, label, dim, embedding, first, weight) of the different vectors that can link, from keyed_vectors()."""
    classes = rows.where("h IS NOT NULL").groupBy("h", "g").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    return cut(classes.select(F.monotonically_increasing_id().alias("class"), "h", "g", "label", F.size("embedding").alias("dim"), "embedding", "first", "weight"))


def window_links(classes: DataFrame, cosine: float = COSINE, window: int = WINDOW, passes: range = range(8), seed: int = SEED) -> DataFrame:
    """Rows (a, b): verified links that connect what the windows of all ``passes`` found, at most one for each row and pass."""
    kind = classes.schema["embedding"].dataType.simpleString()
    label_kind = classes.schema["label"].dataType.simpleString()

    def project(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                x = _matrix(some.column(3))
                for p in passes:
                    directions = np.random.default_rng((seed, p, dim)).standard_normal((dim, BITS))
                    bits = (x @ directions > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), p, np.int16)), *(some.column(i) for i in (1, 2)), pa.array(bits), *(some.column(i) for i in (0, 3))], ["pass", "label", "dim", "hash", "class", "embedding"])

    def compare(batches):
        before = None
        for batch in batches:
            if before is not None:
                batch = pa.concat_batches([before, batch])
            before = batch.slice(max(0, len(batch) - window))
            change = np.zeros(len(batch), bool)
            for i in (0, 1, 2):
                column = batch.column(i).to_numpy(zero_copy_only=False)
                change[1:] |= column[1:] != column[:-1]
            run, dims = np.cumsum(change), batch.column(2).to_numpy(zero_copy_only=False)
            ids, roots = batch.column(4).to_numpy(zero_copy_only=False), np.arange(len(batch))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _matrix(batch.column(5).take(pa.array(at)))
                own = run[at]
                for step in range(1, min(window, len(at) - 1) + 1):
                    near = np.einsum("ij,ij->i", x[:-step], x[step:]) >= cosine
                    near = np.flatnonzero(near & (own[:-step] == own[step:]))
                    union(roots, at[near], at[near + step])
            moved = np.flatnonzero(roots != np.arange(len(batch)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[roots[moved]])], ["a", "b"])

    order = ["pass", "label", "dim", "hash"]
    return (
        classes.select("class", "label", "dim", "embedding")
        .mapInArrow(project, f"pass short, label {label_kind}, dim int, hash long, class long, embedding {kind}")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order, "class")
        .mapInArrow(compare, "a long, b long")
        .distinct()
    )


def linked_roots(classes: DataFrame, cosine: float = COSINE, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """Rows (class, root) of all classes that the windows link, root being the smallest class that links reach.

    ``passes`` sets a fixed number of them. Otherwise passes_for() the largest label come first, then rounds of half as
    many, until a round joins no more than MISS of all that has been joined.
    """
    done = passes or passes_for(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1, cosine, window)
    links = cut(window_links(classes, cosine, window, range(done)))
    step = max(4, done // 2)
    while True:
        roots = cut(connected_components(links).select(F.col("node").alias("class"), "root"))
        if passes:
            return roots
        more = window_links(classes, cosine, window, range(done, done + step))
        done += step
        a, b = (roots.select(F.col("class").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
        ends = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        more = cut(ends.where("a <> b").distinct())
        new, joined = more.count(), roots.where("class <> root").count()
        if new:
            links = links.unionByName(more)
        if new <= MISS * joined:
            return cut(connected_components(links).select(F.col("node").alias("class"), "root")) if new else roots


def component_links(members: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Rows (class, links): the exact number of linked vectors, copies counted, of each class of ``members`` (class, root, embedding, weight).

    A component of up to SMALL_BLOCK classes is one group; a larger one is cut into blocks by hash and every two of
    its blocks are a group. A group gives one row for each of its members.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(SMALL_BLOCK), F.least(F.lit(LARGE_BLOCK), F.ceil(F.col("n") / BLOCKS)))
    cutup = members.join(sizes, "root").withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    own = cutup.withColumn("own", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = own.select("root", "own", other, "class", "weight", "embedding")
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "class", "weight", "embedding")

    def solve(batch):
        ids, weights = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
        second = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        x, counts = _matrix(batch.column(6)), np.zeros(len(batch), np.int64)
        p = np.flatnonzero(~second)
        q = np.flatnonzero(second)
        same = batch.column(1)[0].as_py() == batch.column(2)[0].as_py()
        for at in range(0, len(p), 1024):
            rows = p[at : at + 1024]
            near = x[rows] @ x[p if same else q].T >= cosine
            if same:
                near[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
                counts[rows] += near @ weights[p]
            else:
                counts[rows] += near @ weights[q]
                counts[q] += weights[rows] @ near
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], ["class", "links"])

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

    counted = (
        dealt.repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j")
        .select("root", "i", "j", "second", "class", "weight", "embedding")
        .mapInArrow(compare, "class long, links long")
    )
    return counted.groupBy("class").agg(F.sum("links").alias("links"))


def embedding_groups(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """Rows (vec_id, label, n_links, component_id, kept), one for each row of ``vectors``.

    Two vectors of the same label and length link at ``cosine`` or more, in double precision; a null label or vector,
    a zero vector and one with null or non-finite components link with nothing. component_id is the smallest vec_id
    that links reach, the row's own included; rows with a null vec_id never name a component unless all of it is null.
    Repeated rows are vectors of their own; other columns are not read; an empty table gives no rows.
    """
    columns = {"vec_id": vec_id, "label": label, "embedding": embedding}
    rows = keyed_vectors(vectors.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()]))
    classes = vector_classes(rows)
    roots = linked_roots(classes, cosine, window, passes)
    members = cut(classes.join(roots, "class").select("class", "root", "embedding", "weight", "first"))
    links = component_links(members.drop("first"), cosine)
    names = members.groupBy("root").agg(F.min("first").alias("name"))
    named = members.join(names, "root").select("class", "name").join(links, "class", "left")
    found = classes.select("class", "h", "g", "weight", "first").join(named, "class", "left").select(
        "h", "g", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("name", "first").alias("component_id")
    )
    out = rows.select("vec_id", "label", "h", "g").join(found, ["h", "g"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", "label", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
