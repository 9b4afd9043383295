"""Materialized views: named snapshots as Parquet with a small table of their states."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class View:
    name: str
    interval_ms: int
    refreshed_ms: int | None = None
    generation: int = 0
    valid: bool = False


class Views:
    """Views under one folder of the shared file system; each refresh writes a new generation and then the view's state.

    `archived` generations stay readable until they are swept.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._sources: dict[str, Callable[[], DataFrame]] = {}
        self._states: dict[str, View] = {}

    def create(self, name: str, source: Callable[[], DataFrame], interval_ms: int) -> None:
        if name in self._states:
            raise ValueError(f"view {name} exists")
        self._sources[name], self._states[name] = source, View(name, interval_ms)

    def refresh(self, name: str, now_ms: int) -> None:
        """A failure leaves the view invalid and raises."""
        state = self._states[name]
        state.valid = False
        state.generation += 1
        self._sources[name]().write.mode("overwrite").parquet(self._path(state))
        state.refreshed_ms, state.valid = now_ms, True
        self.spark.createDataFrame([(json.dumps(asdict(state)),)], "state string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}/state")

    def refresh_if_due(self, name: str, now_ms: int) -> bool:
        state = self._states[name]
        due = not state.valid or state.refreshed_ms is None or now_ms - state.refreshed_ms >= state.interval_ms
        if due:
            self.refresh(name, now_ms)
        return due

    def invalidate(self, name: str) -> None:
        self._states[name].valid = False

    def query(self, name: str) -> DataFrame:
        state = self._states[name]
        if not state.valid:
            raise ValueError(f"view {name} is not valid")
        return self.spark.read.parquet(self._path(state))

    def reload(self, name: str, source: Callable[[], DataFrame]) -> None:
        """Take up a view that another session has left."""
        self._sources[name] = source
        self._states[name] = View(**json.loads(self.spark.read.text(f"{self.root}/{name}/state").first()[0]))

    def expired(self, now_ms: int, ttl_ms: int) -> list[str]:
        return sorted(n for n, s in self._states.items() if s.refreshed_ms is not None and s.refreshed_ms + ttl_ms < now_ms)

    def drop(self, name: str) -> None:
        self._states.pop(name)
        self._sources.pop(name)

    def states(self) -> DataFrame:
        rows = [(s.name, s.valid, s.generation, s.refreshed_ms) for s in self._states.values()]
        return self.spark.createDataFrame(rows, "name string, valid boolean, generation int, refreshed_ms long").orderBy(F.col("name"))

    def _path(self, state: View) -> str:
        return f"{self.root}/{state.name}/generation={state.generation}"
