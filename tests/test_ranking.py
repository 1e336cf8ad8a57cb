import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import ranking as K

PENDING = "user_id long, job_id long"


def terms_of(spark, rows, key):
    """Token lists by the column expression, for the plain version."""
    return {r[0]: r[1] for r in spark.createDataFrame(rows, f"{key} long, t string").select(key, X.tokens(F.col("t"))).collect()}


def plain_similarities(titles, bodies, wanted, pending):
    """{(user, job): similarity} from token lists."""
    counts = {j: Counter(bodies[j]) + Counter({w: 3 * n for w, n in Counter(titles[j]).items()}) for j in bodies}
    by_user = defaultdict(list)
    for u, j in pending:
        by_user[u].append(j)
    out = {}
    for u, jobs in by_user.items():
        df = Counter(w for j in jobs for w in counts[j])
        weigh = lambda c: {w: (1 + math.log(f)) * math.log(1 + len(jobs) / (1 + df[w])) for w, f in c.items()}  # noqa: B023, E731
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        mine = weigh(Counter(wanted[u]))
        for j in jobs:
            theirs = weigh(counts[j])
            dot = sum(x * mine.get(w, 0) for w, x in theirs.items())
            out[u, j] = None if not norm(mine) else dot / (norm(theirs) * norm(mine)) if theirs else 0.0
    return out


def candidates(seed=1):
    rnd = random.Random(seed)
    words = ["c++", "C#", ".NET", "node.js", "Machine Learning", "full-stack", "r", "c", "x", "é", "été", "Ünï", "the", "and", "+a+", "#b", "_u_", "²x", "٣", "naïve", "İstanbul", "日本語"] + [f"w{i}" for i in range(60)]
    text = lambda n: rnd.choice([" ", ", ", "/", "\n"]).join(rnd.choices(words, k=n))
    postings = [(j, text(rnd.randrange(0, 5)), text(rnd.randrange(0, 80))) for j in range(300)] + [(300, None, None), (301, "", "the and"), (302, "w1", "w1 " * 3000)]
    profiles = [(1, text(40)), (2, text(5)), (3, "the of and"), (4, None), (5, text(200))]
    pending = sorted({(rnd.choice([1, 1, 1, 2, 3, 4, 5]), j) for j, _, _ in postings for _ in range(3)})
    return postings, profiles, pending


@pytest.mark.parametrize("slice_of,shard_of", [(K.SLICE, K.SHARD), (7, 20)])
def test_similarities_of_all_users(spark, slice_of, shard_of):
    postings, profiles, pending = candidates()
    titles, bodies, wanted = (terms_of(spark, rows, "k") for rows in ([(j, t) for j, t, _ in postings], [(j, b) for j, _, b in postings], profiles))
    want = plain_similarities(titles, bodies, wanted, pending)
    terms = K.posting_terms(spark.createDataFrame(postings, "job_id long, title string, body string"), "job_id", F.col("title"), F.col("body"))
    mine = K.posting_terms(spark.createDataFrame(profiles, "user_id long, t string"), "user_id", None, F.col("t"))
    got = {(r.user_id, r.job_id): r.similarity for r in K.candidate_similarities(terms, spark.createDataFrame(pending, PENDING), mine, "user_id", "job_id", slice_of, shard_of).collect()}
    assert got.keys() == want.keys() == set(pending)
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9), (k, got[k], v)
    assert {u for (u, _), v in got.items() if v is None} == {3, 4}


def test_terms_are_those_of_the_expression(spark):
    import xxhash

    postings, _, _ = candidates(2)
    rows = spark.createDataFrame(postings, "job_id long, title string, body string")
    tokens = terms_of(spark, [(j, b) for j, _, b in postings], "k")
    for r in K.posting_terms(rows, "job_id", None, F.col("body")).collect():
        want = {(xxhash.xxh64_intdigest(w, 42) + 2**63) % 2**64 - 2**63: n for w, n in Counter(tokens[r.job_id]).items()}
        assert dict(zip(r.ids, r.counts, strict=True)) == want, r.job_id


FACTS = "job_id long, seniority string, skills array<string>, digest string, years int, work_mode string"
PROFILES = "user_id long, markdown string, max_years int, levels array<string>, needs_sponsorship boolean"
NURSE = "# Profile\n## Target roles\n- Night nurse, cardiac ward\n## Skills\n- cardiac care, telemetry, triage, phlebotomy\n## Experience\n- Ran a blood bank"


def ranks(spark, facts, profiles, titles, similar=None, learned=None, bodies=None):
    jobs = sorted(titles)
    postings = spark.createDataFrame([(j, titles[j], (bodies or {}).get(j, "")) for j in jobs], "job_id long, title string, body string")
    users = [p[0] for p in profiles]
    rows = K.rank_pending(spark.createDataFrame(profiles, PROFILES), postings, spark.createDataFrame([(u, j) for u in users for j in jobs], PENDING), spark.createDataFrame(facts, FACTS), similar, learned)
    return {(r.user_id, r.job_id): r for r in rows.collect()}


def test_fit_ranks_above_and_too_many_years_well_below(spark):
    care = ["cardiac care", "telemetry", "triage"]
    facts = [(1, "mid", care, "Night nurse on a cardiac ward.", 2, None), (2, "mid", ["Welding", "Rigging"], "Builds ships.", 2, None), (3, "senior", care, "Night nurse on a cardiac ward.", 8, None)]
    titles = {1: "Night nurse", 2: "Shipwright", 3: "Night nurse", 4: "Clerk"}
    similar = spark.createDataFrame([(7, 1, 0.8), (7, 2, 0.3), (7, 3, 0.8)], "user_id long, job_id long, similarity double")
    got = ranks(spark, facts, [(7, NURSE, 5, None, None)], titles, similar)
    assert got[7, 1].blend > got[7, 2].blend and got[7, 1].blend > got[7, 3].blend + 3
    assert (got[7, 1].exact, got[7, 1].estimate) == (85.0, 85) and min(got[7, j].exact for j in (1, 2, 3)) == 35.0
    assert got[7, 4].blend is None and 35 <= got[7, 4].estimate <= 85 and got[7, 4].exact == got[7, 4].estimate
    without = ranks(spark, facts, [(7, NURSE, 5, None, None)], titles)
    assert without[7, 1].blend > without[7, 2].blend


def test_a_blocker_counts_only_for_those_it_blocks(spark):
    filler = [(i + 3, "mid", ["Welding", "Rigging", "Sums"], d, None, "hybrid") for i, d in enumerate(["Runs a ward.", "Builds ships.", "Sells boats.", "Teaches sums."])]
    facts = [(1, "mid", ["triage"], "Triage work.", None, None), (2, "mid", ["triage"], "Triage work. Requires an active secret clearance.", None, None), *filler]
    titles = dict.fromkeys(range(1, 7), "Nurse")
    cleared = NURSE + "\n- Holds an active secret clearance"
    got = ranks(spark, facts, [(1, cleared, 0, ["mid"], False), (2, cleared, 0, ["mid"], True), (3, NURSE, 0, ["mid"], False)], titles)
    lead = {u: got[u, 1].blend - got[u, 2].blend for u in (1, 2, 3)}
    assert abs(lead[2] - lead[1] - 1.5) < 1e-9 and lead[3] - lead[1] > 0.75


def test_levels_years_and_remote_work_order(spark):
    base = ("mid", ["triage", "telemetry", "phlebotomy"], "Care work.")
    facts = [(1, *base, 1, "remote"), (2, *base, 5, "remote"), (3, "senior", *base[1:], 1, "remote"), (4, *base, 1, "onsite"), (5, "mid", ["blood bank", "triage", "telemetry"], base[2], 1, "remote"), (6, "mid", ["Rigging", "triage", "telemetry"], base[2], 1, "remote")]
    got = ranks(spark, facts, [(1, NURSE, 5, ["entry", "mid"], False)], dict.fromkeys(range(1, 7), "Nurse"))
    blend = {j: got[1, j].blend for j in range(1, 7)}
    assert blend[1] > blend[2] and blend[1] > blend[3] and blend[1] > blend[4]
    assert blend[5] > blend[6]  # known from anywhere in the profile


def test_what_was_learned_is_mixed_in(spark):
    facts = [(j, "mid", ["triage"], f"Care work {j}.", None, None) for j in range(1, 6)]
    learned = spark.createDataFrame([(1, j, float(10 - j), 1000) for j in range(1, 6)], "user_id long, job_id long, learned double, n long")
    got = ranks(spark, facts, [(1, NURSE, 0, [], False), (2, NURSE, 0, [], False)], dict.fromkeys(range(1, 6), "Nurse"), learned=learned)
    assert [j for j in sorted(range(1, 6), key=lambda j: -got[1, j].exact)] == [1, 2, 3, 4, 5]
    assert len({got[2, j].exact for j in range(1, 6)}) == 1  # all alike: 85


def test_no_facts_no_terms_no_postings(spark):
    titles, bodies = {1: "Night nurse", 2: "Clerk"}, {1: "cardiac ward triage", 2: "files"}
    got = ranks(spark, [], [(1, NURSE, 0, [], False), (2, "the and", 0, [], False)], titles, bodies=bodies)
    assert [got[1, j].estimate for j in (1, 2)] == [85, 35] and [got[2, j].estimate for j in (1, 2)] == [50, 50]
    assert ranks(spark, [], [(1, NURSE, 0, [], False)], {}) == {}
