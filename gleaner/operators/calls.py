"""Calls of external models behind an interface: a client is given, so tests and checks use a deterministic one."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.latest import budget_cut


def model_replies(rows: DataFrame, client: Callable[[list[str]], Iterable[str | None]], prompt: str = "prompt", batch: int = 32, failures: int = 12) -> DataFrame:
    """``rows`` with a column ``reply``: what ``client`` answers to each prompt, ``batch`` prompts a call.

    A call that raises, or that does not give one reply for each prompt, leaves its replies null; a task that has
    ``failures`` such calls in a row makes no more, so an outage costs little. The client is sent to the tasks once.
    """
    names = [c for c in rows.columns if c != prompt]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + ["reply string"])

    def run(batches):
        failed = 0
        for whole in batches:
            for at in range(0, len(whole), batch):
                some = whole.slice(at, batch)
                prompts = some.column(some.num_columns - 1).to_pylist()
                replies = [None] * len(prompts)
                if failed < failures:
                    try:
                        given = list(client(prompts))
                        if len(given) != len(prompts):
                            raise ValueError(f"{len(given)} replies to {len(prompts)} prompts")
                        replies, failed = given, 0
                    except Exception:  # noqa: BLE001  an external service may fail in any way
                        failed += 1
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(names))), pa.array(replies, pa.string())], [*names, "reply"])

    return rows.select(*names, F.col(prompt).alias(prompt)).mapInArrow(run, schema)


def embedded(rows: DataFrame, client: Callable[[list[str]], Iterable[tuple[int, list[float]]]], text: str = "text", batch: int = 32) -> DataFrame:
    """``rows`` with a column ``vector``: what ``client`` gives for each text, ``batch`` texts a call.

    The client gives (index, vector) pairs in any order. A call that raises, or that does not give each index once and
    vectors of one length, fails the task: a vector in the wrong row would never be noticed later.
    """
    names = [c for c in rows.columns if c != text]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + ["vector array<float>"])

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), batch):
                some = whole.slice(at, batch)
                texts = [t or "" for t in some.column(some.num_columns - 1).to_pylist()]
                given = sorted((i, v) for i, v in client(texts))
                if [i for i, _ in given] != list(range(len(texts))) or len({len(v) for _, v in given}) > 1:
                    raise ValueError(f"{len(given)} vectors for {len(texts)} texts, or of different lengths")
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(names))), pa.array([v for _, v in given], pa.list_(pa.float32()))], [*names, "vector"])

    return rows.select(*names, F.col(text).alias(text)).mapInArrow(run, schema)


def scored_within(rows: DataFrame, client: Callable[[list[str]], Iterable[str | None]], keys: list[str], cost: str, budget: Column, *order: Column, prompt: str = "prompt", batch: int = 32, failures: int = 12) -> DataFrame:
    """Replies for the rows of each key in ``order`` as long as the ``cost`` of those before them is under ``budget``; the others wait and are left out.

    One job cuts by budget with a running sum, one calls the model for what is inside. See model_replies() for what a
    failed call leaves; rows without a reply are asked again by the next run.
    """
    return model_replies(budget_cut(rows, keys, cost, budget, *order), client, prompt, batch, failures)
