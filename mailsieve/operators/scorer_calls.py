"""Calls of an external scorer: spacing, repeats, and a ledger of replies that outlives tasks and runs.

Prompts are hashed by fingerprint into partitions, sorted there and cut into calls of at most ``call_size``, so a task
that runs again makes the same calls. Right after a call its replies are written to the ledger, as one file named after
the call's fingerprints. A repeated task finds the file and does not call again; a later run reads the whole ledger
first and asks only for fingerprints that have no reply. So at most the call under way is paid twice when an executor is
lost. Prompts that fail leave no reply, hence are asked again by the next run. Without a ledger replies live in the run.

The ledger's address must be reachable from every executor. Speculative execution can make a call twice, so leave it off
for these stages. ``compact`` joins the files of finished runs into few, between runs.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.sources.mailbox import open_path

# A scorer takes a batch of prompts and returns one raw reply per prompt.
Scorer = Callable[[Sequence[str]], Sequence[str]]
LEDGER = "fingerprint string, reply string"
_ROWS = pa.schema([("fingerprint", pa.string()), ("reply", pa.string())])


@dataclass(frozen=True)
class CallRules:
    ledger: str | None = None
    call_size: int = 50
    #: partitions, hence calls at a time; None: as many as the shuffle has
    concurrency: int | None = None
    #: calls a second of all partitions together; needs ``concurrency``
    calls_per_second: float | None = None
    #: calls that a partition may make at once after a pause
    burst: int = 1
    #: errors that pass: the call is repeated after a pause that doubles; others are met by halving the call
    passing: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError)
    repeats: int = 3
    first_pause: float = 0.5


class Bucket:
    """A token bucket: ``take`` waits until a call may be made."""

    def __init__(self, per_second: float | None, burst: int, clock=time.monotonic, sleep=time.sleep):
        self.per_second, self.burst, self.clock, self.sleep = per_second, burst, clock, sleep
        self.tokens, self.seen = float(burst), clock()

    def take(self) -> None:
        if not self.per_second:
            return
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.seen) * self.per_second) - 1
        self.seen = now
        if self.tokens < 0:
            self.sleep(-self.tokens / self.per_second)


def ask(scorer: Scorer, prompts: list[str], rules: CallRules, bucket: Bucket) -> list[tuple[str | None, str | None]]:
    """(reply, error) for each prompt. Only prompts that fail by themselves get errors."""
    pause = rules.first_pause
    for attempt in range(rules.repeats + 1):
        bucket.take()
        try:
            replies = list(scorer(prompts))
            if len(replies) != len(prompts):
                raise ValueError("scorer gave a wrong number of replies")
            return [(r, None) for r in replies]
        except rules.passing as problem:
            if attempt == rules.repeats:
                return [(None, str(problem))] * len(prompts)
            bucket.sleep(pause)
            pause *= 2
        except Exception as problem:  # the mail is kept, the run goes on
            if len(prompts) == 1:
                return [(None, str(problem))]
            half = len(prompts) // 2
            return ask(scorer, prompts[:half], rules, bucket) + ask(scorer, prompts[half:], rules, bucket)
    return []


def _name(fingerprints: list[str]) -> str:
    return "call-" + hashlib.sha256("\n".join(f or "" for f in fingerprints).encode()).hexdigest() + ".parquet"


def _written(system: fs.FileSystem, path: str) -> dict[str, str] | None:
    if system.get_file_info([path])[0].type != fs.FileType.File:
        return None
    with system.open_input_file(path) as source:
        rows = pq.read_table(source).to_pydict()
    return dict(zip(rows["fingerprint"], rows["reply"]))


def _write(system: fs.FileSystem, folder: str, name: str, replies: dict[str, str]) -> None:
    """Whole or not at all: readers pass over names that begin with a dot."""
    draft = f"{folder}/.{name}"
    with system.open_output_stream(draft) as out:
        pq.write_table(pa.table({"fingerprint": list(replies), "reply": list(replies.values())}, schema=_ROWS), out)
    system.move(draft, f"{folder}/{name}")


def _call_all(scorer: Scorer, rules: CallRules):
    per_second = rules.calls_per_second and rules.calls_per_second / rules.concurrency

    def call(fingerprints: list[str], prompts: list[str], bucket: Bucket, ledger) -> list[tuple[str | None, str | None]]:
        name = _name(fingerprints)
        known = _written(ledger[0], f"{ledger[1]}/{name}") if ledger else None
        if known is not None:
            return [(known.get(f), None if f in known else "no reply in the ledger") for f in fingerprints]
        answers = ask(scorer, prompts, rules, bucket)
        replies = {f: a[0] for f, a in zip(fingerprints, answers) if f is not None and a[0] is not None}
        if ledger and replies:
            _write(*ledger, name, replies)
        return answers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = Bucket(per_second, rules.burst)
        ledger = open_path(rules.ledger) if rules.ledger else None
        held: list[tuple[str, str]] = []

        def flush(size: int) -> pd.DataFrame:
            fingerprints, prompts = map(list, zip(*held[:size]))
            del held[:size]
            answers = call(fingerprints, prompts, bucket, ledger)
            return pd.DataFrame({"fingerprint": fingerprints, "reply": [a[0] for a in answers], "error": [a[1] for a in answers]})

        for batch in batches:
            held.extend(zip(batch["fingerprint"], batch["prompt"]))
            while len(held) >= rules.call_size:
                yield flush(rules.call_size)
        if held:
            yield flush(len(held))

    return run


def read_ledger(spark: SparkSession, address: str) -> DataFrame:
    """One reply for each fingerprint that has been answered."""
    system, path = open_path(address)
    system.create_dir(path, recursive=True)
    return spark.read.schema(LEDGER).parquet(address).groupBy("fingerprint").agg(F.min("reply").alias("reply"))


def replies(pending: DataFrame, scorer: Scorer, rules: CallRules = CallRules()) -> DataFrame:
    """(fingerprint, prompt) rows -> fingerprint, reply, error, one row for each distinct fingerprint. Rows without
    fingerprint are one prompt, which a ledger does not keep."""
    if rules.calls_per_second and not rules.concurrency:
        raise ValueError("calls_per_second needs concurrency")
    distinct = pending.groupBy("fingerprint").agg(F.min("prompt").alias("prompt"))
    known = None
    if rules.ledger:
        known = read_ledger(pending.sparkSession, rules.ledger)
        known = distinct.select("fingerprint").join(known, "fingerprint").withColumn("error", F.lit(None).cast("string"))
        distinct = distinct.join(known.select("fingerprint"), "fingerprint", "left_anti")
    # an exchange of fixed width: adaptive execution must not merge partitions, or calls would differ between attempts
    width = rules.concurrency or int(pending.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartition(width, "fingerprint").sortWithinPartitions("fingerprint")
    fresh = dealt.mapInPandas(_call_all(scorer, rules), "fingerprint string, reply string, error string")
    return fresh if known is None else known.unionByName(fresh)


def compact(spark: SparkSession, address: str, joined: int = 1000) -> None:
    """Join about ``joined`` files of the ledger into one each. The new ones are there before the old ones go, and equal replies may lie
    in both, so a run that is lost here loses nothing. Not while another run writes."""
    system, path = open_path(address)
    system.create_dir(path, recursive=True)
    old = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet") and not f.base_name.startswith(".")]
    files = -(-len(old) // joined)
    if len(old) > files:
        read_ledger(spark, address).repartition(files, "fingerprint").write.mode("append").parquet(address)
        for name in old:
            system.delete_file(name)
