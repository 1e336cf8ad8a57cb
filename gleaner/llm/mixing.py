"""Mixing of sources to target weights on a low-discrepancy schedule.

Slot k of the schedule has the golden-ratio point frac(k * phi); the cumulative weights of the sources divide [0, 1),
so every stretch of the schedule holds each source near its share. The n-th slot of a source takes its n-th block of
words: its documents, in hashed order, make a stream that is cut into blocks of equal length and read up to
``repeats`` times. Blocks are as long as each other within a source; a source of less than LEAST_BLOCKS whole blocks
has shorter ones and accordingly more slots, so that what is taken of it comes within about a thousandth of its words.
Ranks and stream positions are prefix sums in two levels, so no source is one task's work.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import cut, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: A source's words may be taken so many times.
REPEATS = 3
#: Words of a block at most, and blocks that a source is cut into at least (words allowing).
BLOCK, LEAST_BLOCKS = 2048, 1024
#: Slots whose ranks are counted together.
STRETCH = 1024


def source_plan(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """Rows (source, source_size, target, block, blocks, low, high, slots) from rows (source, size); one for each source.

    Weights repeat over the sources by code point, null last. All words are shared by weight; a source stops at
    ``repeats`` times its words and what it leaves is shared by weight among the others: with the sources in order of
    ratio = repeats * words / weight, the first whose level (words not yet given / weights not yet served) does not
    exceed its ratio sets the level of all that follow. The windows run over one row for each source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = totals.withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size").cast("double"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"]
    rows = rows.withColumn("target", F.least("cap", level * F.col("weight")))
    total = F.sum("source_size").over(everything)
    limit = F.greatest(F.lit(block), F.ceil(total / F.lit(1 << 30)))  # at most about 2^30 slots
    rows = rows.withColumn("block", F.greatest(F.lit(1), F.least(limit, F.ceil(F.col("source_size") / LEAST_BLOCKS))).cast("long"))
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    rows = rows.withColumn("wanted", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    slots = F.sum("wanted").over(everything)
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    high = F.sum("wanted").over(upto)
    return rows.select(
        "source",
        "source_size",
        "target",
        "block",
        "blocks",
        F.when(slots > 0, (high - F.col("wanted")) / slots).otherwise(0.0).alias("low"),
        F.when(high >= slots, F.lit(1.0)).otherwise(high / slots).alias("high"),
        F.round(slots).cast("long").alias("slots"),
        F.col("wanted"),
    ).where(F.col("source_size").isNotNull())


def schedule(plan: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Rows (slot, source, rank, round, block_no): which block of which source each slot takes.

    Ranks past ``repeats`` readings of a source are left out: the words that this loses are within the few slots that
    a golden-ratio schedule may be off.
    """
    spark = plan.sparkSession
    head = plan.agg(F.max("slots"), F.count("*")).first()
    slots, cells = int(head[0] or 0), 1 << max(10, math.ceil(math.log2(max(1, head[1]))))
    # frac(k * phi) in 31-bit fixed point: 1327217885 is odd and next to phi * 2^31
    point = ((F.col("id") % (1 << 31)) * F.lit(1327217885)) % (1 << 31) / F.lit(float(1 << 31))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    spans = plan.where(F.col("high") > F.col("low")).select(
        "source", "blocks", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))).alias("cell")
    )
    dealt = points.join(spans, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    dealt = dealt.select("slot", "source", "blocks", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    counts = dealt.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    past = F.sum("n").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("source").alias("_source"), F.col("stretch").alias("_stretch"), F.coalesce(past, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1
    ranked = dealt.withColumn("own", own).join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("stretch") == F.col("_stretch")))
    ranked = ranked.withColumn("rank", F.col("start") + F.col("own")).where(F.col("rank") < F.col("blocks") * repeats)
    return ranked.select("slot", "source", "rank", F.floor(F.col("rank") / F.col("blocks")).alias("round"), (F.col("rank") % F.col("blocks")).alias("block_no"))


def pieces(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (row, source, block_no, start, n): the words of each document that stand in each block of its source's stream.

    ``sized``: (row, source, size, place), where ``place`` is the document's hashed order; the stream position is the
    sum of the sizes before it in its chunk of places and of all chunks before that.
    """
    chunk_bits = max(1, math.ceil(math.log2(2 * math.sqrt(max(1, sized.count())))))
    chunked = sized.where("size > 0").withColumn("chunk", F.shiftright("place", 64 - chunk_bits))
    sums = chunked.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    past = F.sum("words").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col("source").alias("_source"), F.col("chunk").alias("_chunk"), F.coalesce(past, F.lit(0)).alias("before"))
    own = F.sum("size").over(Window.partitionBy("source", "chunk").orderBy("place", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1))
    placed = chunked.withColumn("own", F.coalesce(own, F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("chunk") == F.col("_chunk")))
    lengths = plan.select(F.col("source").alias("_source2"), "block")
    placed = placed.withColumn("at", F.col("before") + F.col("own")).join(lengths, F.col("source").eqNullSafe(F.col("_source2")))
    first, last = F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block"))
    cutup = placed.select("row", "source", "size", "at", "block", F.explode(F.sequence(first, last)).alias("block_no"))
    begin = F.greatest("at", F.col("block_no") * F.col("block"))
    end = F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * F.col("block"))
    return cutup.select("row", "source", "block_no", (begin - F.col("at")).alias("start"), (end - begin).alias("n"))


def sized_rows(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    digest = F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(F.col(text)))
    return cut(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), digest.alias("place"))
    )


def mixture(sized: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The source plan, and the mix as rows (slot, source, round, block_no, row, start, n) in schedule order of ``slot``."""
    plan = cut(source_plan(sized.select("source", "size"), weights, repeats, block))
    slots = schedule(plan, repeats)
    parts = pieces(sized, plan).withColumnsRenamed({"source": "_source", "block_no": "_block"})
    mix = slots.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block_no") == F.col("_block")))
    return plan, mix.select("slot", "source", "round", "block_no", "row", "start", "n")


def mix_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken), one for each row of ``docs``.

    size counts the words, taken those that the mix takes of the row, repeats counted: at most ``repeats`` times its
    size. Null texts have no words; a null source is a source and comes last; a source without words has target 0;
    repeated rows are mixed one by one; other columns are not read; an empty table gives no rows. Orders depend on
    doc_id, text and seed alone, so reruns agree.
    """
    sized = sized_rows(docs, doc_id, text, source, seed)
    plan, mix = mixture(sized, weights, repeats)
    taken = mix.groupBy("row").agg(F.sum("n").alias("taken"))
    targets = plan.select(F.col("source").alias("_source"), "source_size", "target")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).join(taken, "row", "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@F.pandas_udf(T.StringType())
def word_range(texts: pd.Series, starts: pd.Series, counts: pd.Series) -> pd.Series:
    """The text from word ``start`` on, ``n`` words long, with what stands between them; null stays null."""

    def part(text, start, n):
        if text is None:
            return None
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)][int(start) : int(start + n)]
        return text[spans[0][0] : spans[-1][1]] if spans else ""

    return pd.Series([part(*x) for x in zip(texts, starts, counts, strict=True)], dtype=object)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", weights=WEIGHTS, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """The mix as documents with the columns of ``docs``, whatever their names: a row for each reading of a document, cut to the words taken.

    Rows with the same doc_id, text and source are one document here, null or not; which of them stays is open where
    they differ in other columns. Documents without words and those that the mix does not reach are left out;
    ``n_chars``, where there is such a column, is counted anew. Texts are shuffled once, to the takes of their key.
    """
    own, own_text, own_source = (F.col(f"`{c}`") for c in (doc_id, text, source))
    digests = [F.xxhash64(F.lit(k), own, own.isNull(), own_text, own_text.isNull(), own_source, own_source.isNull()) for k in (0, 1)]
    keys = [digests[0].alias("_h"), digests[1].alias("_g")]
    rows = docs.select(*keys, own.alias("doc_id"), own_source.alias("source"), word_count(own_text).alias("size"), F.xxhash64(F.lit(seed), own, F.xxhash64(own_text)).alias("place"))
    sized = cut(rows.dropDuplicates(["_h", "_g"]).withColumn("row", F.monotonically_increasing_id()))
    _, mix = mixture(sized, weights, repeats)
    takes = mix.groupBy("row", "round").agg(F.min("start").alias("_start"), F.sum("n").alias("_n"))
    takes = sized.select("row", "_h", "_g", F.col("size").alias("_size")).join(takes, "row").drop("row")
    packed = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    joined = packed.join(takes, ["_h", "_g"]).dropDuplicates(["_h", "_g", "round"])  # no further shuffle: it is dealt by the key
    old = {c: F.col("_doc").getField(c) for c in docs.columns}
    part = word_range(F.when(F.col("_n") < F.col("_size"), old[text]), "_start", "_n")
    out = joined.withColumn("_new", F.coalesce(part, old[text]))
    new = {text: F.col("_new")}
    if n_chars in old:
        new[n_chars] = F.length("_new").cast(docs.schema[n_chars].dataType)
    return out.select(*[new.get(c, old[c]).alias(c) for c in docs.columns])
