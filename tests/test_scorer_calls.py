"""Calls of the external scorer: the ledger, repeats, spacing."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import cascade, scorer_calls
from mailsieve.operators.scorer_calls import Bucket, CallRules, ask


def counting(folder, fail=None):
    """A scorer that leaves a file for each prompt it was paid for."""
    def scorer(prompts):
        if fail is not None and any(fail in p for p in prompts):
            raise KeyboardInterrupt("executor lost")
        for p in prompts:
            open(os.path.join(folder, f"{p}-{uuid.uuid4().hex}"), "w").close()
        return ['{"is_spam":true}'] * len(prompts)
    return scorer


def paid(folder):
    return [n.split("-")[0] for n in os.listdir(folder)]


@pytest.fixture
def pending(spark):
    return spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"), F.concat(F.lit("p"), F.col("id")).alias("prompt"))


def test_a_run_that_dies_half_way_does_not_pay_twice(spark, tmp_path, pending):
    calls = tmp_path / "calls"
    calls.mkdir()
    rules = CallRules(ledger=str(tmp_path / "ledger"), call_size=20, concurrency=4)
    with pytest.raises(Exception):
        cascade.external_score(pending, counting(str(calls), "p777"), calls=rules).collect()
    before = paid(calls)
    assert 0 < len(before) < 1000
    kept = {r.fingerprint for r in scorer_calls.read_ledger(spark, rules.ledger).collect()}
    assert kept and len(kept) >= len(before) - 4 * 20  # at most the call under way of each partition
    rows = cascade.external_score(pending.unionByName(pending), counting(str(calls)), calls=rules).collect()
    assert len(rows) == 1000 and {r.decision.action for r in rows} == {"SPAM"}
    assert len(paid(calls)) <= 1000 + 4 * 20 and set(paid(calls)) == {f"p{i}" for i in range(1000)}
    bought = len(paid(calls))
    scorer_calls.compact(spark, rules.ledger)
    assert len([f for f in os.listdir(rules.ledger) if f.endswith(".parquet")]) == 1
    assert cascade.external_score(pending, counting(str(calls)), calls=rules).where("decision.action = 'SPAM'").count() == 1000
    assert len(paid(calls)) == bought


def test_a_repeated_task_finds_its_calls(spark, tmp_path, pending):
    """The same partition once more, as after a lost executor: the plan is the old one, the ledger has its calls."""
    calls = tmp_path / "calls"
    calls.mkdir()
    found = scorer_calls.replies(pending, counting(str(calls)), CallRules(ledger=str(tmp_path / "ledger"), call_size=20, concurrency=4))
    first = sorted(map(tuple, found.collect()))
    assert sorted(map(tuple, found.collect())) == first and len(first) == len(paid(calls)) == 1000


def test_failed_prompts_and_missing_fingerprints_are_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", "good"), ("b", "bad"), (None, "good"), (None, "other"), ("c", None)], "fingerprint string, prompt string")
    rules = CallRules(ledger=str(tmp_path / "ledger"), first_pause=0.0)

    def scorer(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return ["fine"] * len(prompts)

    for _ in range(2):
        got = {r.fingerprint: (r.reply, r.error) for r in scorer_calls.replies(rows, scorer, rules).collect()}
        assert got == {"a": ("fine", None), "b": (None, "no"), None: ("fine", None), "c": ("fine", None)}
    assert {r.fingerprint for r in scorer_calls.read_ledger(spark, rules.ledger).collect()} == {"a", "c"}
    got = {r.fingerprint: r.reply for r in scorer_calls.replies(rows, lambda p: ["new"] * len(p), rules).collect()}
    assert got == {"a": "fine", "b": "new", None: "new", "c": "fine"}
    assert scorer_calls.replies(rows.limit(0), scorer, rules).collect() == []


def test_passing_errors_are_repeated_with_doubled_pauses():
    pauses, tries = [], []
    bucket = Bucket(None, 1, sleep=pauses.append)

    def scorer(prompts):
        tries.append(len(prompts))
        if len(tries) < 4:
            raise TimeoutError("busy")
        return ["x"] * len(prompts)

    assert ask(scorer, ["a", "b"], CallRules(), bucket) == [("x", None)] * 2
    assert pauses == [0.5, 1.0, 2.0] and tries == [2, 2, 2, 2]

    def down(prompts):
        raise ConnectionError("down")
    assert ask(down, ["a", "b"], CallRules(repeats=1), bucket) == [(None, "down")] * 2


def test_calls_are_spaced():
    now, waited = [0.0], []

    def sleep(seconds):
        waited.append(seconds)
        now[0] += seconds

    bucket = Bucket(10, 2, clock=lambda: now[0], sleep=sleep)
    for _ in range(12):
        bucket.take()
    assert sum(waited) == pytest.approx(1.0) and now[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        scorer_calls.replies(None, None, CallRules(calls_per_second=1.0))
