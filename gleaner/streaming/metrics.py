"""Counters and histograms of what runs through a plan, observed by Spark while it runs.

A metric is a set of aggregates that ``df.observe`` computes beside the query, so nothing is read twice, and only their
values come to the driver: one for each declared label or bucket. A registry adds them up over runs and batches and
gives them in the text form that scrapers read. Labels are declared beforehand; values that are not count as ``other``.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

OTHER = "other"
#: Bounds, in seconds, of fetches and of model calls.
FETCH_SECONDS, CALL_SECONDS = (0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30), (0.25, 0.5, 1, 2, 5, 10, 30, 60)


@dataclass(frozen=True)
class Counter:
    """The sum of ``value`` (1 a row by default), in all or for each of ``values`` of ``label``; null adds nothing."""

    name: str
    help: str
    value: Column | None = None
    label: str | None = None
    labelled: Column | None = None
    values: tuple[str, ...] = ()
    kind = "counter"

    def columns(self) -> dict[str, Column]:
        amount = F.lit(1).cast("double") if self.value is None else F.coalesce(self.value.cast("double"), F.lit(0.0))
        total = lambda when: F.coalesce(F.sum(F.when(when, amount)), F.lit(0.0))
        if self.label is None:
            return {self.name: total(F.lit(True))}
        known = {v: F.coalesce(self.labelled == v, F.lit(False)) for v in self.values}
        return {f"{self.name}|{v}": total(is_v) for v, is_v in known.items()} | {f"{self.name}|{OTHER}": total(~F.coalesce(self.labelled.isin(*self.values), F.lit(False)))}

    def lines(self, sums: dict[str, float]) -> list[str]:
        if self.label is None:
            return [f"{self.name} {sums[self.name]:g}"]
        shown = [v for v in (*self.values, OTHER) if v != OTHER or sums[f"{self.name}|{OTHER}"]]
        return [f'{self.name}{{{self.label}="{_escaped(v)}"}} {sums[f"{self.name}|{v}"]:.12g}' for v in shown]


@dataclass(frozen=True)
class Histogram:
    """How many of ``value`` are at most each of ``bounds``, their number and their sum; nulls are left out."""

    name: str
    help: str
    value: Column
    bounds: tuple[float, ...]
    kind = "histogram"

    def columns(self) -> dict[str, Column]:
        counts = {f"{self.name}|{b:g}": F.count(F.when(self.value <= b, 1)).cast("double") for b in self.bounds}
        return counts | {f"{self.name}|+Inf": F.count(self.value).cast("double"), f"{self.name}|sum": F.coalesce(F.sum(self.value.cast("double")), F.lit(0.0))}

    def lines(self, sums: dict[str, float]) -> list[str]:
        of = lambda k: sums[f"{self.name}|{k}"]
        buckets = [f'{self.name}_bucket{{le="{b}"}} {of(b):.12g}' for b in (*(f"{x:g}" for x in self.bounds), "+Inf")]
        return [*buckets, f"{self.name}_sum {of('sum'):.12g}", f"{self.name}_count {of('+Inf'):.12g}"]


def _escaped(value: str) -> str:
    return value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


@dataclass
class Registry:
    """Sums of declared metrics over everything that was observed."""

    name: str
    metrics: tuple[Counter | Histogram, ...]
    sums: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._lock = threading.Lock()
        self.sums = {c: 0.0 for m in self.metrics for c in m.columns()}

    def _aggregates(self) -> list[Column]:
        return [c.alias(name) for m in self.metrics for name, c in m.columns().items()]

    def add(self, observed: dict[str, float]) -> None:
        with self._lock:
            for name in self.sums:
                self.sums[name] += observed.get(name) or 0.0

    def observe(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        """``df`` that is watched for its next action, and what to hand to ``collect`` after that."""
        watch = Observation(self.name)
        return df.observe(watch, *self._aggregates()), watch

    def collect(self, watch: Observation) -> None:
        self.add(watch.get)

    def observe_stream(self, df: DataFrame) -> DataFrame:
        """A streaming ``df`` that ``listener`` hears of after each batch."""
        return df.observe(self.name, *self._aggregates())

    def listener(self) -> StreamingQueryListener:
        """For ``spark.streams.addListener``: adds what each batch of any query observed under this registry's name."""
        registry = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                pass

            def onQueryProgress(self, event) -> None:
                seen = event.progress.observedMetrics.get(registry.name)
                if seen is not None:
                    registry.add(seen.asDict())

            def onQueryIdle(self, event) -> None:
                pass

            def onQueryTerminated(self, event) -> None:
                pass

        return Listener()

    def text(self) -> str:
        """All sums in the text form of metrics."""
        with self._lock:
            parts = [[f"# HELP {m.name} {m.help}", f"# TYPE {m.name} {m.kind}", *m.lines(self.sums)] for m in self.metrics]
        return "".join(line + "\n" for part in parts for line in part)


def scoring_metrics(models: tuple[str, ...]) -> Registry:
    """Metrics of scored rows (model, result, prompt_tokens, cached_tokens, completion_tokens, cost_cents, seconds)."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    return Registry(
        "scoring",
        (
            Counter("scoring_requests_total", "Scoring requests by result.", label="result", labelled=F.col("result"), values=("scored", "excluded", "score_failed", "skipped")),
            Counter("scoring_model_requests_total", "Scoring requests by model.", label="model", labelled=F.col("model"), values=models),
            Counter("scoring_tokens_total", "Prompt and completion tokens.", tokens),
            Counter("scoring_cached_tokens_total", "Prompt tokens out of the cache.", F.col("cached_tokens")),
            Counter("scoring_cost_usd_total", "Cost in USD.", F.col("cost_cents") / 100),
            Histogram("scoring_latency_seconds", "Latency of scoring calls.", F.col("seconds"), CALL_SECONDS),
        ),
    )


def exclusion_metrics(reasons: tuple[str, ...]) -> Registry:
    """Metrics of judged postings (reason, null for those that stay)."""
    return Registry("exclusions", (Counter("postings_excluded_total", "Postings excluded, by reason.", F.when(F.col("reason").isNotNull(), 1), "reason", F.col("reason"), reasons), Counter("postings_judged_total", "Postings judged.")))
