"""Named timers and counters of a run, and where they are reported."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: name, kind (timer or counter), count, total (seconds, or what was added), least and most of one entry.
SCHEMA = "name string, kind string, n long, total double, least double, most double"


class Metrics:
    """Timers and counters by name; held in the driver, a few numbers per name."""

    def __init__(self) -> None:
        self._found: dict[tuple[str, str], list[float]] = {}

    def _add(self, name: str, kind: str, value: float) -> None:
        x = self._found.setdefault((name, kind), [0, 0.0, float("inf"), float("-inf")])
        x[0], x[1], x[2], x[3] = x[0] + 1, x[1] + value, min(x[2], value), max(x[3], value)

    def count(self, name: str, value: float = 1.0) -> None:
        self._add(name, "counter", value)

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self._add(name, "timer", time.monotonic() - began)

    def rows(self) -> list[tuple]:
        return [(name, kind, int(x[0]), float(x[1]), float(x[2]), float(x[3])) for (name, kind), x in sorted(self._found.items())]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), SCHEMA)

    def report(self, to: Callable[[str], None] = print) -> None:
        """A line per name to a console, a logger or a file's write."""
        for name, kind, n, total, least, most in self.rows():
            to(f"{name}\t{kind}\t{n}\t{total:.6g}\t{least:.6g}\t{most:.6g}")

    def hooks(self, name: str) -> tuple[Callable, Callable]:
        """Hooks for before and after a program's rounds: time of each and how many there were."""
        began = [0.0]

        def before(k: int, state: DataFrame) -> None:
            began[0] = time.monotonic()

        def after(k: int, state: DataFrame) -> None:
            self._add(f"{name}.round", "timer", time.monotonic() - began[0])
            self.count(f"{name}.rounds")

        return before, after
