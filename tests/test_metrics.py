import time

from pyspark.sql import functions as F

from gleaner.plans.tables import Tables
from gleaner.streaming.metrics import CALL_SECONDS, Counter, Registry, exclusion_metrics, scoring_metrics

SF = "/root/testdata/sf0.001"


def calls(spark):
    result = F.element_at(F.array(*map(F.lit, ("scored", "excluded", "score_failed", "odd"))), (F.col("id") % 4 + 1).cast("int"))
    seconds = F.when(F.col("id") % 10 > 0, F.col("score") / 40)
    return Tables(spark, SF).analyses.select("id", F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"), result.alias("result"), "prompt_tokens", "cached_tokens", "completion_tokens", "cost_cents", seconds.alias("seconds"))


def expected(rows):
    rows = rows.collect()
    own = lambda c: [r[c] for r in rows if r[c] is not None]
    want = {f"scoring_requests_total|{v}": float(own("result").count(v)) for v in ("scored", "excluded", "score_failed", "skipped")} | {"scoring_requests_total|other": float(own("result").count("odd"))}
    want |= {f"scoring_model_requests_total|{m}": float(own("model").count(m)) for m in ("m0", "m1")} | {"scoring_model_requests_total|other": float(own("model").count("m2"))}
    want |= {"scoring_tokens_total": float(sum(own("prompt_tokens")) + sum(own("completion_tokens"))), "scoring_cached_tokens_total": float(sum(own("cached_tokens"))), "scoring_cost_usd_total": sum(own("cost_cents")) / 100}
    want |= {f"scoring_latency_seconds|{b:g}": float(sum(s <= b for s in own("seconds"))) for b in CALL_SECONDS}
    return want | {"scoring_latency_seconds|+Inf": float(len(own("seconds"))), "scoring_latency_seconds|sum": sum(own("seconds"))}


def near(got, want, times=1):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - times * v) <= 1e-6 * max(1, abs(times * v)) for k, v in want.items()), {k: (got[k], v) for k, v in want.items() if abs(got[k] - times * v) > 1e-6}


def test_figures_equal_an_aggregate_of_the_same_run(spark):
    registry, rows = scoring_metrics(("m0", "m1")), calls(spark)
    for _ in range(2):
        watched, watch = registry.observe(rows)
        assert watched.count() == rows.count()
        registry.collect(watch)
    near(registry.sums, expected(rows), times=2)
    text = registry.text()
    assert 'scoring_requests_total{result="skipped"} 0\n' in text and "# TYPE scoring_latency_seconds histogram\n" in text
    assert f'scoring_latency_seconds_bucket{{le="+Inf"}} {registry.sums["scoring_latency_seconds|+Inf"]:.12g}\n' in text


def test_a_stream_is_heard_batch_by_batch(spark, tmp_path):
    rows, registry = calls(spark), scoring_metrics(("m0", "m1"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    live = registry.observe_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    listener = registry.listener()
    spark.streams.addListener(listener)
    try:
        live.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        deadline = time.time() + 30
        while registry.sums["scoring_latency_seconds|+Inf"] < rows.where("seconds IS NOT NULL").count() and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    near(registry.sums, expected(rows))


def test_exclusions_and_empty_runs(spark):
    registry = exclusion_metrics(("title:senior",))
    rows = spark.createDataFrame([("title:senior",), ("new reason",), (None,)], "reason string")
    for frame in (rows, rows.limit(0)):
        watched, watch = registry.observe(frame)
        watched.count()
        registry.collect(watch)
    assert registry.sums == {"postings_excluded_total|title:senior": 1.0, "postings_excluded_total|other": 1.0, "postings_judged_total": 3.0}
    assert Registry("x", (Counter("n", "N."),)).text() == "# HELP n N.\n# TYPE n counter\nn 0\n"
