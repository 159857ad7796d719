"""Translation runs: batches dispatched to an injected translator, retried, paced, stopped early and resumed.

A translator is a function ``list[dict] -> list[dict]`` (rows with ``id`` and ``lines`` to rows with ``id`` and
``translation_lines``) that may raise ``Recoverable``. Batches run on executors; what is saved decides what is pending,
so a run that stops can be resumed by running it again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import remove, scratch


class Recoverable(Exception):
    """A failure worth another try (rate limit, timeout, connection, server)."""


def with_retry(call: Callable[[], list], attempts: int = 3, delay: float = 2.0, sleep=time.sleep) -> list:
    """Another try after ``delay * n`` seconds, for recoverable failures only."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Recoverable:
            if n == attempts:
                raise
            sleep(delay * n)
    raise AssertionError


class Pace:
    """At least so many seconds between calls of one task; tasks share a limit by dividing it."""

    def __init__(self, per_minute: float, tasks: int = 1, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.next, self.clock, self.sleep = 60.0 * tasks / per_minute, 0.0, clock, sleep

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


RESULT = "batch_id long, fact_id string, translation_lines array<string>, error string"


def dispatch(batches: DataFrame, translate: Callable, per_minute: float | None = None, attempts: int = 3, delay: float = 0.0, tasks: int | None = None) -> DataFrame:
    """Rows ``(batch_id, fact_id, lines)`` -> results. Each batch is one call: its rows are brought to one task (of
    ``tasks``, by default the session's shuffle partitions, which bound the concurrency) and sorted together, and a task
    holds one batch at a time. A batch with unknown, missing or repeated ids fails as a whole (J22)."""
    n = tasks or int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(bid, ids: list, lines: list, pace: Pace | None) -> list[tuple]:
        error, answers = None, {}
        try:
            if pace:
                pace.wait()
            ask = [{"id": i, "lines": list(x)} for i, x in zip(ids, lines, strict=True)]
            got = with_retry(lambda: translate(ask), attempts, delay)
            known = set(ids)
            answers = {x["id"]: x["translation_lines"] for x in got if x["id"] in known}
            if len([x for x in got if x["id"] in answers]) != len(answers):
                error, answers = "duplicate_id", {}
        except Recoverable as e:
            error = f"recoverable: {e}"
        except Exception as e:  # noqa: BLE001 - a translator's failure is a row, not a failed job
            error = f"fatal: {e}"
        return [(bid, i, answers.get(i), None if i in answers else error or "missing_id") for i in ids]

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(per_minute, n) if per_minute else None
        held, ids, lines = None, [], []
        out = lambda rows: pd.DataFrame(rows, columns=["batch_id", "fact_id", "translation_lines", "error"])
        for b in parts:
            for bid, g in b.groupby("batch_id", sort=False):
                if ids and bid != held:
                    yield out(send(held, ids, lines, pace))
                    ids, lines = [], []
                held = bid
                ids += g["fact_id"].tolist()
                lines += g["lines"].tolist()
        if ids:
            yield out(send(held, ids, lines, pace))

    whole = batches.where("batch_id is not null").select("batch_id", "fact_id", "lines").repartition(n, "batch_id").sortWithinPartitions("batch_id")
    return whole.mapInPandas(step, RESULT)


def run(spark: SparkSession, pending: DataFrame, translate: Callable, save: Callable[[DataFrame], None], slices: int = 4, stop_rate: float = 0.5, time_limit: float | None = None) -> dict:
    """Dispatch the pending batches slice by slice; the results of a slice are written once, so that no
    later step calls the translator again, then saved, and the run stops when failed / processed reaches ``stop_rate``
    or time is up. Returns the run's counters."""
    state = {"sent": 0, "succeeded": 0, "failed": 0, "stop_reason": "finished"}
    began = time.monotonic()
    for k in range(slices):
        path = scratch(spark, "results")
        dispatch(pending.where(F.pmod(F.col("batch_id"), F.lit(slices)) == k), translate).write.parquet(path)
        done = spark.read.parquet(path)
        save(done)
        r = done.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad")).head()
        remove(spark, path)
        state["sent"] += r["n"]
        state["failed"] += r["bad"]
        state["succeeded"] += r["n"] - r["bad"]
        if state["sent"] and state["failed"] / state["sent"] >= stop_rate:
            state["stop_reason"] = "error_rate"
            break
        if time_limit is not None and time.monotonic() - began > time_limit:
            state["stop_reason"] = "time_limit"
            break
    return state


def counters(results: DataFrame) -> DataFrame:
    """Per run its batches and rows: sent, succeeded, failed for good, worth another try, and batches that failed as
    a whole. Results with ``run_id``."""
    bad = F.col("error").isNotNull()
    again = F.coalesce(F.col("error").startswith("recoverable"), F.lit(False))
    batch = results.groupBy("run_id", "batch_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(again).alias("again"))
    return batch.groupBy("run_id").agg(F.count("*").alias("batches"), F.sum("n").alias("sent"), (F.sum("n") - F.sum("bad")).alias("succeeded"), (F.sum("bad") - F.sum("again")).alias("failed"), F.sum("again").alias("retryable"), F.count_if(F.col("bad") == F.col("n")).alias("failed_batches"))


def rebuild_reasons(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Why an index must be rebuilt: one row ``(index_key, reason)`` of the stored against the current
    fingerprints (``source_hash``, ``rules_hash``, ``item_count``)."""
    s = stored.select("index_key", *[F.col(c).alias(f"s_{c}") for c in ("source_hash", "rules_hash", "item_count")])
    return current.join(s, "index_key", "left").select(
        "index_key",
        F.when(F.col("s_source_hash").isNull(), "missing").when(F.col("s_source_hash") != F.col("source_hash"), "source_changed")
        .when(F.col("s_rules_hash") != F.col("rules_hash"), "rules_changed").when(F.col("s_item_count") != F.col("item_count"), "count_changed").otherwise("current").alias("reason"),
    )
