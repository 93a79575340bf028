"""Tasks from tables to tables, with declared dependencies and a manifest to resume from."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

Task = Callable[..., DataFrame]


@dataclass
class Pipeline:
    """Runs registered tasks in the order of their dependencies.

    A task gets the tables it needs by parameter name (inputs and results of
    other tasks) and settings by name; its result is written to
    ``<folder>/<task>``, so each task starts from tables, not from a long plan.
    Finished tasks are listed in the manifest and skipped by later runs.
    """

    spark: SparkSession
    folder: str
    inputs: dict[str, DataFrame]
    settings: dict[str, object] = field(default_factory=dict)
    tasks: dict[str, Task] = field(default_factory=dict)

    def task(self, f: Task) -> Task:
        if f.__name__ in self.tasks:
            raise ValueError(f"{f.__name__} is registered already")
        self.tasks[f.__name__] = f
        return f

    def needs(self, name: str) -> list[str]:
        code = self.tasks[name].__code__
        return list(code.co_varnames[: code.co_argcount])

    def finished(self) -> list[str]:
        try:
            rows = self.spark.read.schema("task string").json(f"{self.folder}/manifest/*").collect()
        except AnalysisException:
            return []
        return sorted(r["task"] for r in rows)

    def order(self, names: list[str] | None = None) -> list[str]:
        """Tasks and what they depend on, dependencies first."""
        done: list[str] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise ValueError(f"tasks depend on each other: {' > '.join((*path, name))}")
            if name in done:
                return
            if name not in self.tasks:
                raise KeyError(f"unknown task {name}")
            for need in self.needs(name):
                if need in self.tasks:
                    visit(need, (*path, name))
                elif need not in self.inputs and need not in self.settings and not self._has_default(name, need):
                    raise ValueError(f"{name} needs {need}, which is no task, table or setting")
            done.append(name)

        for name in names or list(self.tasks):
            visit(name, ())
        return done

    def _has_default(self, name: str, need: str) -> bool:
        f = self.tasks[name]
        return need in self.needs(name)[len(self.needs(name)) - len(f.__defaults__ or ()) :]

    def result(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def run(self, names: list[str] | None = None) -> list[str]:
        """Runs what isn't finished; returns the names of the tasks that ran."""
        known, ran = self.finished(), []
        for name in self.order(names):
            if name in known:
                continue
            given = {}
            for need in self.needs(name):
                if need in self.tasks:
                    given[need] = self.result(need)
                elif need in self.inputs:
                    given[need] = self.inputs[need]
                elif need in self.settings:
                    given[need] = self.settings[need]
            self.tasks[name](**given).write.mode("overwrite").parquet(f"{self.folder}/{name}")
            self.spark.createDataFrame([(name,)], "task string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/{name}")
            ran.append(name)
        return ran

    def settings_json(self) -> str:
        return json.dumps(self.settings, sort_keys=True, default=str)
