"""Scoring in waves that follow what the service answers: its true costs, its limits, and whether it is there at all.

Each wave asks for the next rows of every user: one at first, which lets the service keep the user's prompt, then as many
as the user's width. What came back is written to the shared folder, and sums by user decide the next wave: whose budget
is spent stops, and a width is halved where the service turned calls away. Users stay in a table; the driver sees totals.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.joins import materialized, met
from gleaner.streaming.lifecycle import shared_folder

OUTCOME = [("stage", pa.string()), ("reply", pa.string()), ("cost", pa.float64()), ("calls", pa.int32()), ("limited", pa.bool_()), ("wait", pa.float64())]


@dataclass
class Answer:
    """What a service says to a prompt: a text, and what it cost; or that it turned the call away, and for how many seconds."""

    text: str | None = None
    cost: float = 0.0
    limited: bool = False
    wait: float = 0.0


def _asked(client: Callable[[str], Answer], prompt: str, valid: Callable[[str], bool] | None, again: str) -> tuple:
    """(stage, reply, cost, calls, limited, wait) of one prompt; a reply that is not valid is asked for once more."""
    cost, calls = 0.0, 0
    for text in (prompt, prompt + again):
        try:
            calls += 1
            answer = client(text)
        except Exception:  # noqa: BLE001  an external service may fail in any way
            return ("failed" if calls > 1 else "skipped"), None, cost, calls, False, 0.0
        cost += answer.cost
        if answer.limited or answer.text is None:
            return ("failed" if calls > 1 else "skipped"), None, cost, calls, answer.limited, answer.wait
        if valid is None or valid(answer.text):
            return "scored", answer.text, cost, calls, False, answer.wait
    return "failed", answer.text, cost, calls, False, answer.wait


def _wave(rows: DataFrame, client, valid, again: str, failures: int) -> DataFrame:
    """``rows`` (the prompt last) with what became of each; after ``failures`` calls in a row that failed a task makes no more."""
    names = rows.columns[:-1]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + ["stage string, reply string, cost double, calls int, limited boolean, wait double"])

    def run(batches):
        failed = 0
        for batch in batches:
            found = []
            for prompt in batch.column(batch.num_columns - 1).to_pylist():
                found.append(_asked(client, prompt or "", valid, again) if failed < failures else ("skipped", None, 0.0, 0, False, 0.0))
                failed = failed + 1 if found[-1][0] == "skipped" else 0
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*found, strict=True), OUTCOME, strict=True)] if found else [pa.array([], kind) for _, kind in OUTCOME]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *columns], [*names, *[c for c, _ in OUTCOME]])

    return rows.mapInArrow(run, schema)


def scored_in_waves(rows: DataFrame, client: Callable[[str], Answer], user: str, order: list[Column], budgets: DataFrame, prompt: str = "prompt", width: int = 32, failures: int = 12, valid: Callable[[str], bool] | None = None, again: str = "\n\nReply with valid JSON only.", sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Rows of ``rows`` without the prompt, with stage (scored or failed), reply, cost and calls: those that were answered, best first.

    ``budgets``: (user, budget); a user's rows are asked for in ``order`` while what was spent is under their budget, at
    the costs that the service names. Calls that failed or were turned away leave their rows out, so the next run asks
    again; the widths of users with calls that were turned away are halved, and the next wave waits as long as the
    service said. A wave in which every call failed counts its calls, and after ``failures`` such calls no more are made
    at all. A reply for which ``valid`` is false is asked for once more, at its own cost, and then counts as failed.
    Users without a budget and rows of a null user are left out.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/waves-{uuid.uuid4().hex}"
    ranked = materialized(rows.withColumn("_rank", F.row_number().over(Window.partitionBy(user).orderBy(*order))))
    state = met(budgets.select(user, "budget"), ranked.groupBy(user).agg(F.count("*").alias("_n")), user)
    state = materialized(state.select("*", F.lit(1).alias("_next"), F.lit(1).alias("_width"), F.lit(0.0).alias("_spent")))
    names, streak, wave = [c for c in rows.columns if c != prompt], 0, 0
    while True:
        live = state.where((F.col("_spent") < F.col("budget")) & (F.col("_next") <= F.col("_n"))).select(user, "_next", "_width")
        chosen = met(ranked, live, user).where((F.col("_rank") >= F.col("_next")) & (F.col("_rank") < F.col("_next") + F.col("_width")))
        made = _wave(chosen.select(*names, F.col(prompt).alias("_prompt")), client, valid, again, failures)
        made.write.parquet(f"{folder}/{wave}")
        done = spark.read.schema(made.schema).parquet(f"{folder}/{wave}")
        total = done.agg(F.count("*").alias("n"), F.count_if(F.col("stage") == "skipped").alias("failed"), F.count_if("limited").alias("limited"), F.max("wait").alias("wait")).first()
        if not total.n:
            break
        wave += 1
        streak = streak + total.failed if total.failed == total.n and not total.limited else 0
        if streak >= failures:
            break
        sums = done.groupBy(user).agg(F.count("*").cast("int").alias("_got"), F.sum("cost").alias("_cost"), F.max("limited").alias("_limited"))
        moved = met(state, sums, user, how="left")
        wider = F.when(F.col("_limited"), F.greatest(F.lit(1), F.floor(F.col("_width") / 2)).cast("int")).when((F.col("_next") == 1) & F.col("_got").isNotNull(), width).otherwise(F.col("_width"))
        state = materialized(moved.select(user, "budget", "_n", (F.col("_next") + F.coalesce("_got", F.lit(0))).alias("_next"), wider.alias("_width"), (F.col("_spent") + F.coalesce("_cost", F.lit(0.0))).alias("_spent")))
        if total.wait:
            sleep(total.wait)
    paths = [f"{folder}/{i}" for i in range(max(1, wave))]
    return spark.read.schema(made.schema).parquet(*paths).where("stage <> 'skipped'").select(*names, "stage", "reply", "cost", "calls")
