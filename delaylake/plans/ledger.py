"""Which steps of a run have ended: a small table beside the lake.

A run is one pass over a list of steps. Each attempt at a step leaves a row when it begins and
another when it ends or fails, so that a run that was cut off is taken up at the first step that
has not ended, and the next run begins when all have.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

BEGUN, ENDED, FAILED = "begun", "ended", "failed"
_SCHEMA = (
    "at timestamp, plan string, report string, error string, "
    "run int, step string, attempt int, outcome string"
)


@dataclass
class Run:
    number: int
    #: Reports of the steps that have ended, and attempts at each step so far.
    reports: dict = field(default_factory=dict)
    attempts: dict[str, int] = field(default_factory=dict)


class Ledger:
    """The rows below ``path``, one small file each, in folders by run, step, attempt, outcome."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self):
        """All rows; they are as many as there were attempts."""
        try:
            return self.spark.read.schema(_SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], _SCHEMA)
            raise

    def open_run(self, steps: list[str]) -> Run:
        """The last run, if it was for the same steps and one of them has not ended; else a new
        one."""
        table, plan = self.table(), ",".join(steps)
        number = table.agg(F.max("run")).first()[0]
        if number is None:
            return Run(1)
        rows = table.where(F.col("run") == number).collect()
        run = Run(number)
        for row in rows:
            run.attempts[row["step"]] = max(run.attempts.get(row["step"], 0), row["attempt"])
            if row["outcome"] == ENDED:
                run.reports[row["step"]] = json.loads(row["report"], object_hook=_with_numbers)
        unfinished = set(steps) - set(run.reports)
        if unfinished and all(row["plan"] == plan for row in rows):
            return run
        return Run(number + 1)

    def note(self, run: Run, plan: str, step: str, attempt: int, outcome: str, **what) -> None:
        folder = f"{self.path}/run={run.number}/step={step}/attempt={attempt}/outcome={outcome}"
        columns = {name: F.lit(what.get(name)).cast("string") for name in ("report", "error")}
        self.spark.range(1).select(
            F.current_timestamp().alias("at"),
            F.lit(plan).alias("plan"),
            *[c.alias(name) for name, c in columns.items()],
        ).coalesce(1).write.mode("overwrite").parquet(folder)


def _with_numbers(found: dict) -> dict:
    """JSON has text for keys that were numbers."""
    return {int(k) if k.isdigit() else k: v for k, v in found.items()}


def run_steps(
    ledger: Ledger,
    work: Mapping[str, Callable[[], object]],
    retries: int,
    seconds: float,
    sleep: Callable[[float], None] = time.sleep,
) -> dict:
    """Each step's report, of this call or, where it had ended in the same run, an earlier one.

    A step that fails is tried again ``retries`` times, after ``seconds``; then its error ends
    the run, which the next call takes up there.
    """
    plan, run = ",".join(work), ledger.open_run(list(work))
    for step, act in work.items():
        if step in run.reports:
            continue
        first = run.attempts.get(step, 0) + 1
        for attempt in range(first, first + retries + 1):
            ledger.note(run, plan, step, attempt, BEGUN)
            try:
                report = act()
            except Exception as error:
                ledger.note(run, plan, step, attempt, FAILED, error=f"{type(error).__name__}: {error}")
                if attempt == first + retries:
                    raise
                sleep(seconds)
                continue
            ledger.note(run, plan, step, attempt, ENDED, report=json.dumps(report))
            run.reports[step] = report
            break
    return {step: run.reports[step] for step in work}
