"""Independent Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

A, B = TypeVar("A"), TypeVar("B")


class InheritableThreadPool:
    """A pool of threads that keep the caller's job group and local properties; results come in the order of the tasks."""

    def __init__(self, size: int):
        self.threads = ThreadPoolExecutor(size)

    def __enter__(self) -> InheritableThreadPool:
        return self

    def __exit__(self, *_) -> None:
        self.threads.shutdown()

    def map(self, f: Callable[[A], B], tasks: Iterable[A]) -> list[B]:
        session = SparkSession.getActiveSession()
        run = inheritable_thread_target(session)(f) if session else f
        waiting = [self.threads.submit(run, t) for t in tasks]
        return [w.result() for w in waiting]
