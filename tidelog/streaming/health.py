"""Health of subscriptions and archives: plain functions and their column forms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, WARNING, CRITICAL = "OK", "WARNING", "CRITICAL"


@dataclass(frozen=True)
class Threshold:
    """Seconds from which something is a warning, and from which it is critical."""

    warning: float
    critical: float

    def __post_init__(self):
        if self.critical < self.warning:
            raise ValueError("the critical threshold must not be below the warning")

    @classmethod
    def ratio(cls, warning: float, critical_times: float) -> Threshold:
        return cls(warning, warning * critical_times)

    def status(self, seconds: float) -> str:
        return CRITICAL if seconds > self.critical else WARNING if seconds > self.warning else OK

    def column(self, seconds: Column) -> Column:
        return F.when(seconds > self.critical, CRITICAL).when(seconds > self.warning, WARNING).otherwise(OK)


def poll_threshold(run_frequency_seconds: float) -> Threshold:
    """For the time since a subscription was last up to date."""
    return Threshold(max(5.0, 5 * run_frequency_seconds), max(30.0, 10 * run_frequency_seconds))


def poll_status(seconds_since_up_to_date: float | None, threshold: Threshold) -> tuple[str, str]:
    if seconds_since_up_to_date is None:
        return WARNING, "awaiting the first complete read"
    return threshold.status(seconds_since_up_to_date), f"up to date {seconds_since_up_to_date:.0f} s ago"


def subscription_status(started: bool, caught_up: bool, terminated: bool, seconds: float, initial: Threshold, staleness: Threshold) -> tuple[str, str]:
    """``seconds`` since the start before the first catch-up, and since the last one after it."""
    if terminated:
        return CRITICAL, "terminated"
    if not started:
        return WARNING, "not started"
    if not caught_up:
        return initial.status(seconds), f"awaiting initial catch-up for {seconds:.0f} s"
    status = staleness.status(seconds)
    return status, "caught up" if status == OK else f"stale for {seconds:.0f} s"


def store_status(log: DataFrame) -> tuple[str, str]:
    """Whether the log can be read: its last event, or that it has none."""
    try:
        last = log.agg(F.max("position").alias("p")).first()["p"]
    except Exception as e:  # any failure to read is what this reports
        return CRITICAL, str(e)[:200]
    return OK, "no events" if last is None else f"last position {last}"


def archive_connection(max_position: Callable[[], object]) -> tuple[str, str]:
    """Whether an archive can be listed: its last position, as ``max_position`` finds it, or that it is empty."""
    try:
        last = max_position()
    except Exception as e:  # any failure to list is what this reports
        return CRITICAL, str(e)[:200]
    return OK, "empty archive" if last is None else f"archived up to {last}"


def archive_status(live: int, archived: int | None, batch_size: int) -> tuple[str, str]:
    behind = live > 3 * batch_size and (archived is None or live - archived > 3 * batch_size)
    return (WARNING if behind else OK), f"live {live}, archived {archived}"
