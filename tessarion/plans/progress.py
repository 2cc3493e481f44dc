"""Progress and begin/end records; both are optional for callers."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol, TextIO

from pyspark.sql import SparkSession

log = logging.getLogger("tessarion.progress")


class Progress(Protocol):
    def advance(self, done: int, total: int) -> None:
        """Both absolute; the total may rise."""


class Silent:
    def advance(self, done: int, total: int) -> None:
        pass


class Logged:
    """One line for each whole tenth."""

    def __init__(self) -> None:
        self.last = -1

    def advance(self, done: int, total: int) -> None:
        if (now := 10 * done // max(total, 1)) != self.last:
            self.last = now
            log.info("%d of %d", done, total)


class Meter:
    """A bar on a terminal, redrawn at most ten times a second; on anything else, the lines of ``Logged``."""

    def __init__(self, stream: TextIO, width: int = 40) -> None:
        self.stream, self.width, self.drawn = stream, width, 0.0
        self.plain = None if stream.isatty() else Logged()

    def advance(self, done: int, total: int) -> None:
        if self.plain is not None:
            self.plain.advance(done, total)
        elif done >= total or time.monotonic() - self.drawn >= 0.1:
            self.drawn = time.monotonic()
            full = self.width * done // max(total, 1)
            self.stream.write(f"\r[{'#' * full}{'.' * (self.width - full)}] {done} of {total}" + ("\n" if done >= total else ""))
            self.stream.flush()


@contextmanager
def described(spark: SparkSession, what: str) -> Iterator[None]:
    """Jobs begun inside carry this description in Spark's interface and event log."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(what)
    try:
        yield
    finally:
        context.setLocalProperty("spark.job.description", before)


@contextmanager
def bracket(what: str) -> Iterator[None]:
    began = time.monotonic()
    log.debug("begin %s", what)
    try:
        yield
    finally:
        log.debug("end %s after %.3f s", what, time.monotonic() - began)
