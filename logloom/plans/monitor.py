"""Timing, memory, failures and time limits around runs."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from ..operators import reports

R = TypeVar("R")
log = logging.getLogger(__name__)


class PartFailure(RuntimeError):
    """A part of a run that failed for good."""


class PartTimeout(PartFailure):
    """A part that took longer than it may."""


#: What marks each kind of failure in an error's text, in the order in which they are looked for.
REASONS = (("timeout", ("cancel", "timed out", "timeout")), ("OOM", ("OutOfMemory", "MemoryError", "memory limit")), ("signal", ("ExecutorLost", "exit code 137", "SIGKILL", "worker exited")))


def reason_of(error: BaseException) -> str:
    """timeout, OOM, signal (a worker or executor that died) or exception."""
    if isinstance(error, (PartTimeout, TimeoutError)):
        return "timeout"
    text = f"{type(error).__name__} {error}"
    return next((r for r, marks in REASONS if any(m.lower() in text.lower() for m in marks)), "exception")


@dataclass
class Failure:
    """A part that failed, how, at which attempts last, and whether a later one succeeded."""

    part: str
    reason: str
    attempt: int
    at: float
    recovered: bool = False

    def __str__(self) -> str:
        return f"{self.part}: {self.reason} at attempt {self.attempt}, {'recovered' if self.recovered else 'not recovered'}"


@dataclass
class Monitor:
    """Seconds of named phases, memory at their ends, and failures with their recoveries."""

    memory_threshold: float = 80.0
    phases: list[tuple[str, float]] = field(default_factory=list)
    snapshots: list[dict] = field(default_factory=list)
    failures: list[Failure] = field(default_factory=list)
    retries: int = 0
    orphans: int = 0

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.phases.append((name, time.perf_counter() - began))
            self.snapshots.append(memory_snapshot(name))
            if self.snapshots[-1]["percent"] > self.memory_threshold:
                log.warning("%s: %.1f %% of memory in use, above %.1f %%", name, self.snapshots[-1]["percent"], self.memory_threshold)

    def retried(self, task: Callable[[], R], attempts: int = 3, part: str = "part", base: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> R:
        """Runs a job up to so many times, pausing base ** k seconds before attempt k + 1 (none if base is 0).

        Lost tasks are Spark's to run again; this is for jobs that fail as a
        whole.  A failure counts once, as does its recovery; the last error is
        raised: a part that can't be computed is never left out.
        """
        failure = None
        for k in range(1, attempts + 1):
            try:
                out = task()
            except Exception as e:
                if failure is None:
                    failure = Failure(part, reason_of(e), k, time.time())
                    self.failures.append(failure)
                failure.attempt, failure.reason = k, reason_of(e)
                if k == attempts:
                    raise
                self.retries += 1
                if base:
                    sleep(base**k)
            else:
                if failure:
                    failure.recovered = True
                return out
        raise ValueError("attempts must be positive")

    @property
    def recovered(self) -> int:
        return sum(f.recovered for f in self.failures)

    @property
    def recovery_rate(self) -> float:
        return self.recovered / len(self.failures) if self.failures else 1.0

    @property
    def over_threshold(self) -> list[str]:
        return [s["phase"] for s in self.snapshots if s["percent"] > self.memory_threshold]

    def latencies(self, spark: SparkSession) -> DataFrame:
        """Each phase's seconds, share and whether it is the longest."""
        return reports.latency_share(spark.createDataFrame(self.phases, "phase string, seconds double"))

    def failure_report(self) -> str:
        """Counts, and a line for each failure; empty without failures."""
        if not self.failures:
            return ""
        return "\n".join([f"failures {len(self.failures)}, recovered {self.recovered}, retries {self.retries}, orphan files {self.orphans}", *(f"  {f}" for f in self.failures)])

    def memory_report(self) -> str:
        """A line for each phase: megabytes and percentage in use at its end."""
        return "\n".join(f"{s['phase']:<20} {s['used_mb']:>10.1f} MB {s['percent']:>6.1f} %" for s in self.snapshots)


def memory_snapshot(phase: str) -> dict:
    """phase, used_mb, available_mb, total_mb and percent in use of the driver's machine; zeros where they can't be told."""
    try:
        import psutil
    except ImportError:
        return {"phase": phase, "used_mb": 0.0, "available_mb": 0.0, "total_mb": 0.0, "percent": 0.0}
    m, mb = psutil.virtual_memory(), 1024.0 * 1024.0
    return {"phase": phase, "used_mb": round(m.used / mb, 2), "available_mb": round(m.available / mb, 2), "total_mb": round(m.total / mb, 2), "percent": round(m.percent, 2)}


def with_timeout(spark: SparkSession, task: Callable[[], R], seconds: float) -> R:
    """Runs a task and cancels the Spark jobs that it starts once the time is over; the task then fails as a PartTimeout."""
    tag = f"timeout-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    over = threading.Event()

    def end():
        over.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, end)
    sc.addJobTag(tag)
    timer.start()
    try:
        return task()
    except Exception as e:
        if over.is_set():
            raise PartTimeout(f"cancelled after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
