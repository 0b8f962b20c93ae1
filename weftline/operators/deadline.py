"""Runs that end in time: jobs under a deadline, rows under a deadline, and retries of what may pass."""

from __future__ import annotations

import random
import signal
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.mapping import NEVER_RETRIED, map_rows

#: Answers of a service after which another try may help, and names of errors that say the same.
PASSING_STATUS = frozenset({408, 409, 425, 429, 500, 502, 503, 504})
PASSING_NAMES = ("Timeout", "RateLimit", "Connection", "Unavailable", "Temporary")
#: The kind of error of a row that the deadline has not let begin or end.
LATE = "TimeoutError"


class Deadline:
    """Jobs that are started within the block are cancelled seconds after it was entered; then it ends with TimeoutError.

    An interrupt from the keyboard cancels them as well. Jobs of other threads and blocks go on; blocks may be nested."""

    def __init__(self, spark: SparkSession, seconds: float):
        self.sc, self.seconds, self.tag, self.late = spark.sparkContext, seconds, f"weftline-{uuid.uuid4().hex}", False
        self.over, self.timer = threading.Event(), threading.Thread(target=self._end, daemon=True)

    def _end(self) -> None:
        while not self.over.wait(0.1 if self.late else self.seconds):  # again and again: a job may begin after the first time
            self.late = True
            self.cancel()

    def cancel(self) -> None:
        """Ends the jobs that are running now."""
        self.sc.cancelJobsWithTag(self.tag)

    def __enter__(self) -> Deadline:
        self.sc.addJobTag(self.tag)
        self.sc.setInterruptOnCancel(True)
        self.timer.start()
        return self

    def __exit__(self, kind, error, _) -> None:
        self.over.set()
        self.timer.join()
        self.sc.removeJobTag(self.tag)
        if kind is not None and issubclass(kind, KeyboardInterrupt):
            self.cancel()
        elif self.late:
            raise TimeoutError(f"not done after {self.seconds} seconds") from error


def may_pass(error: BaseException) -> bool:
    """Whether another try may help: errors of time and connection, and answers of a service that say so by their status
    (a number under status_code or status) or by their name. Errors of the program never do."""
    if isinstance(error, NEVER_RETRIED):
        return False
    status = getattr(error, "status_code", getattr(error, "status", None))
    if isinstance(status, int):
        return status in PASSING_STATUS
    return isinstance(error, (TimeoutError, ConnectionError)) or any(n in k.__name__ for k in type(error).__mro__ for n in PASSING_NAMES)


def waits(attempts: int, least: float, most: float, seed: object) -> list[float]:
    """How long to wait before each further attempt: a random part of what doubles from least up to most, the same for the
    same seed, so that reruns agree and rows don't all come back at once."""
    r = random.Random(f"{seed}")
    return [min(most, least * 2**k) * (0.5 + r.random() / 2) for k in range(attempts - 1)]


def retried(fn: Callable, attempts: int = 5, least: float = 0.1, most: float = 2.0, passing: Callable[[BaseException], bool] = may_pass) -> Callable:
    """fn with jittered waits between its attempts; what passing doesn't name is raised at once, the last error in any case."""

    def run(row):
        for k, wait in enumerate([*waits(attempts, least, most, row), None]):
            try:
                return fn(row)
            except Exception as e:
                if wait is None or not passing(e):
                    raise
                if k + 1 < attempts:
                    time.sleep(wait)

    return run


def timed(fn: Callable, seconds: float, until: float | None = None) -> Callable:
    """fn, ended by TimeoutError after so many seconds, or at a time (of time.time()) if that comes first.

    The call is interrupted where it is, which a worker's main thread can do; elsewhere only its beginning is checked."""

    def late(*_):
        raise TimeoutError("too late")

    def run(row):
        left = seconds if until is None else min(seconds, until - time.time())
        if left <= 0:
            raise TimeoutError("too late")
        if threading.current_thread() is not threading.main_thread():
            return fn(row)
        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, left)
        try:
            return fn(row)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    return run


def map_until(df: DataFrame, fn: Callable[[dict], object], result: str, seconds: float, each: float | None = None) -> DataFrame:
    """As map_rows with on_error log, but the whole run has so many seconds from now, and a row no more than each.

    Rows that the deadline doesn't let begin or end have a null result and the error TimeoutError: what is done in time is
    kept, and late says which rows to run again. Tasks know the deadline as a point in time, so that one that starts late
    ends at once; clocks of executors must agree to within what matters."""
    return map_rows(df, timed(fn, seconds if each is None else each, time.time() + seconds), result, "log")


def late(mapped: DataFrame) -> DataFrame:
    """Rows of map_until that ran out of time, as they came."""
    return mapped.where(F.col("error_type") == LATE).drop("result", "error_type", "error_message")
