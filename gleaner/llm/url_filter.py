"""URL filter: host and path rules, and for the rest gradient-boosted trees over lexical features.

The trees are fitted on URLs that a rule labels, at most ``SAMPLE`` of them, and judge every URL without a rule.
Each stands twice among their rows, once as if its suffixes were unknown: so the trees learn what other features say,
which is all there is of hosts that no rule knows.
Suffix statistics (how often labelled hosts or paths with an ending are blocked) come from one half of all labelled
URLs, the trees from a sample of the other, so that no URL's own label is among its features. DataFrame operations and Spark's own trees.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

#: Fixed values: (verdict, host, path); a rule fits its host and all subdomains where the URL's path starts with its path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Labelled URLs that the trees are fitted on, at most, and rows that a suffix needs.
SAMPLE, SUPPORT = 200_000, 50
#: Suffixes, all kinds together, up to which their rates are broadcast; more are joined by shuffles.
BROADCAST = 50_000
SUFFIXES = {"top": -1, "domain": -2, "site": -3}
NUMBERS = ["length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "last_length", "query_length"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path; both empty for a null URL or one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.coalesce(F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*+", 0), UPPER, LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1)})


def rule_of(rules=None):
    """Struct (rule, verdict) of the longest rule that fits host and path, else null."""
    ordered = sorted(rules or RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    host, path = F.col("host"), F.col("path")
    return F.coalesce(
        *[
            F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in ordered
        ]
    )


def featured(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` (with host and path) with the lexical features and the suffixes; a null URL counts as empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    kinds = F.array_distinct(F.split(u, "", -1))
    counts = F.transform(kinds, lambda c: (n - F.length(F.replace(u, c, F.lit("")))).cast("double"))
    entropy = F.aggregate(F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda total, k: total - k / n * F.log2(k / n))
    labels = F.split("host", r"\.", -1)
    segments = F.array_remove(F.split("path", "/", -1), "")
    query = F.when(F.contains(u, F.lit("?")), F.substring(u, F.instr(u, "?") + 1, n)).otherwise("")
    return pages.withColumns(
        {
            "length": n,
            "host_length": F.length("host"),
            "labels": F.size(labels),
            "depth": F.size(segments),
            "digit_ratio": F.coalesce(F.try_divide(F.length(F.regexp_replace(u, "[^0-9]+", "")), n), F.lit(0.0)),
            "entropy": F.coalesce(entropy, F.lit(0.0)),
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&", -1))),
            "hyphens": n - F.length(F.replace(u, F.lit("-"), F.lit(""))),
            "last_length": F.coalesce(F.length(F.try_element_at(segments, F.lit(-1))), F.lit(0)),
            "query_length": F.length(query),
            "top": F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("")),
            "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
            "site": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), "."),
            "section": F.concat_ws("/", "top", F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit(""))),
        }
    )


STATISTICS = [*SUFFIXES, "section"]


def suffix_rates(labelled: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Rows (kind, suffix, rate, weight): smoothed share of blocked URLs and log count of each frequent suffix."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("suffix")) for k in STATISTICS])).alias("s")
    counts = labelled.select("label", kinds).groupBy("s.kind", "s.suffix").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    return counts.where(F.col("n") >= support).select("kind", "suffix", ((F.col("bad") + 1) / (F.col("n") + 2)).alias("rate"), F.log1p("n").alias("weight"))


def with_rates(pages: DataFrame, rates: DataFrame) -> DataFrame:
    few = rates.count() <= BROADCAST
    for kind in STATISTICS:
        own = rates.where(F.col("kind") == kind).select(F.col("suffix").alias(kind), F.col("rate").alias(f"{kind}_rate"), F.col("weight").alias(f"{kind}_weight"))
        pages = pages.join(F.broadcast(own) if few else own, kind, "left").fillna({f"{kind}_rate": 0.5, f"{kind}_weight": 0.0})
    return pages


def without_rates(rows: DataFrame) -> DataFrame:
    """``rows`` as with_rates() gives them where no suffix is known."""
    return rows.withColumns({f"{k}_{x}": F.lit(value) for k in STATISTICS for x, value in (("rate", 0.5), ("weight", 0.0))})


def url_filter(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=None, sample: int = SAMPLE, support: int = SUPPORT, trees: int = 20, depth: int = 4) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, score.

    verdict is the rule's, else "block" where the trees' probability of it (score) is at least one half. Without
    labelled URLs of both verdicts there are no trees: the score is then 1 if all labels block, else 0. Repeated rows
    are judged one by one; other columns are not read; an empty table gives no rows.
    """
    rows = parsed(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))).withColumn("fits", rule_of(rules))
    labelled = rows.where(F.col("fits").isNotNull()).select("url", "host", "path", (F.col("fits.verdict") == "block").cast("double").alias("label"), F.xxhash64("url", "page_id").alias("lot"))
    seen = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    n = sum(seen.values())
    chosen = labelled if n <= sample else labelled.where(F.pmod("lot", F.lit(n)) < int(0.98 * sample))
    chosen = cut(featured(chosen, "url"))
    if len(seen) < 2:
        scored = rows.withColumn("score", F.lit(1.0 if 1.0 in seen else 0.0))
    else:
        half = F.pmod(F.xxhash64("url", F.lit("half")), F.lit(2)) == 0
        rates = cut(suffix_rates(featured(labelled, "url").where(half), support))
        assembler = VectorAssembler(inputCols=NUMBERS + [f"{k}_{x}" for k in STATISTICS for x in ("rate", "weight")], outputCol="features")
        own = with_rates(chosen.where(~half), rates)
        if len(own.select("label").distinct().collect()) < 2:
            own = with_rates(chosen, rates)
        training = assembler.transform(own.unionByName(without_rates(own))).select("features", "label")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=9, maxBins=64).fit(training)
        judged = model.transform(assembler.transform(with_rates(featured(rows, "url"), rates)))
        scored = judged.withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("fits.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "score")
