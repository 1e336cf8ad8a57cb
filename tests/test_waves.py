import os
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleaner.operators.waves import Answer, scored_in_waves

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

ROWS = "user_id long, id long, estimate int, prompt string"


class Service:
    """A service that notes its calls in a folder, one file a call, so that all tasks' calls are counted."""

    def __init__(self, folder, answer):
        self.folder, self.answer = str(folder), answer
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, prompt):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(prompt)
        return self.answer(prompt, len(os.listdir(self.folder)))

    @property
    def prompts(self):
        return [open(f"{self.folder}/{f}").read() for f in os.listdir(self.folder)]


def jobs(spark, users, n):
    return spark.createDataFrame([(u, 1000 * u + i, 100 - i % 100, f"u{u} job {i}") for u in users for i in range(n)], ROWS)


def run(spark, rows, service, budgets, **options):
    waits = []
    table = spark.createDataFrame(list(budgets.items()), "user_id long, budget double")
    out = scored_in_waves(rows, service, "user_id", [F.desc("estimate"), F.col("id")], table, sleep=waits.append, **options)
    return sorted(out.collect(), key=lambda r: r.id), waits


def down(prompt, n):
    raise OSError("down")


def test_a_service_that_is_down_gets_few_calls(spark, tmp_path):
    service = Service(tmp_path / "calls", down)
    got, _ = run(spark, jobs(spark, [1], 500), service, {1: 1e9}, width=8)
    assert got == [] and len(service.prompts) <= 12 + 8  # all stay pending


def test_one_failed_call_does_not_stop_the_others(spark, tmp_path):
    def flaky(prompt, n):
        if int(prompt.split()[-1]) % 3 == 0:
            raise OSError("busy")
        return Answer("{}", 0.1)

    service = Service(tmp_path / "calls", flaky)
    got, _ = run(spark, jobs(spark, [1], 60), service, {1: 1e9}, width=16)
    assert len(service.prompts) == 60 and {r.id % 1000 % 3 for r in got} == {1, 2} and len(got) == 40


def test_the_first_call_is_alone_and_budgets_hold_by_true_costs(spark, tmp_path):
    def priced(prompt, n):
        return Answer("{}", 1.0 if prompt.startswith("u1") else 0.5)

    service = Service(tmp_path / "calls", priced)
    got, _ = run(spark, jobs(spark, [1, 2, 3], 50), service, {1: 3.0, 2: 2.0, 3: 0.0}, width=2)
    per_user = {u: [r for r in got if r.user_id == u] for u in (1, 2, 3)}
    assert len(per_user[1]) == 3 and len(per_user[2]) == 5 and not per_user[3]  # 1, 2 and 2: a wave that began under the budget is paid
    assert [r.id for r in per_user[1]] == [1000, 1001, 1002] and sum(r.cost for r in per_user[2]) == 2.5


def test_widths_are_halved_and_waits_kept(spark, tmp_path):
    def limited(prompt, n):
        return Answer(limited=True, wait=7.5) if prompt.endswith((" 1", " 2")) else Answer("{}", 0.1)

    service = Service(tmp_path / "calls", limited)
    got, waits = run(spark, jobs(spark, [1], 13), service, {1: 1e9}, width=8)
    assert waits == [7.5] and {r.id - 1000 for r in got} == set(range(13)) - {1, 2}  # 1, then 8, then 4
    assert len(service.prompts) == 13


def test_a_second_try_is_paid_for(spark, tmp_path):
    service = Service(tmp_path / "calls", lambda prompt, n: Answer("nonsense" if "job 0" in prompt or "valid JSON" not in prompt else "{}", 0.25))
    got, _ = run(spark, jobs(spark, [1], 2), service, {1: 1e9}, valid=lambda text: text == "{}")
    assert [(r.stage, r.cost, r.calls) for r in got] == [("failed", 0.5, 2), ("scored", 0.5, 2)]
    empty, _ = run(spark, jobs(spark, [1], 1).limit(0), service, {1: 1.0})
    assert empty == []
