"""Runs that can be paused, stopped and taken up again.

A run carries its recipe out one top-level step after the other. The rows that a step collects are written under a key of
the recipe up to it, and a cursor notes the step; a run that is taken up again reads the rows of finished steps from there,
so that their sources are not read a second time: of finished steps only the pages they leave open are planned again, and
read if a later step looks at them. A recipe that has been changed before the cursor has other keys and begins anew there.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rowloom.operators.pii_scan import run_warning
from rowloom.plans.compiler import Collected, RecipeError, Result, Sources, compile_recipe
from rowloom.plans.recipe import Recipe, gates, read_recipe
from rowloom.sinks import runs

STATES = ("run", "pause", "stop")


@dataclass
class Run:
    """What a run has come to: result holds the rows of the finished steps; state is done, paused, stopped or failed at
    the step of this number."""

    result: Result
    state: str
    step: int
    warning: str | None = None
    notes: list[str] = field(default_factory=list)


def prefix_keys(recipe: Recipe, run_id: str) -> list[str]:
    """For each top-level step, the key of the recipe up to and with it."""
    def plain(step) -> list:
        return [step.id, step.type, step.config, *([plain(s) for s in part] if part else None for part in (step.children, step.ifBranch, step.elseBranch))]

    out, digest = [], hashlib.sha256(run_id.encode())
    for step in recipe.steps:
        digest.update(json.dumps(plain(step), sort_keys=True, ensure_ascii=False).encode())
        out.append(digest.hexdigest()[:32])
    return out


class _Store(Collected):
    """Writes the rows of each step that finishes, and reads those of steps that have."""

    def __init__(self, spark: SparkSession, root: str, run_id: str, recipe: Recipe):
        self.spark, self.root, self.run_id, self.keys = spark, root, run_id, prefix_keys(recipe, run_id)
        self.ids = [s.id for s in recipe.steps]
        self.finished = self._finished()

    def _finished(self) -> int:
        """How many steps, from the first, have rows under their keys and stand at or before the cursor."""
        if not _exists(self.spark, f"{self.root}/cursors"):
            return 0
        rows = self.spark.read.schema(runs.CURSOR).parquet(f"{self.root}/cursors").where(f"run_id = '{self.run_id}'").select("step_index", "step_id").collect()
        known = {(r.step_index, r.step_id) for r in rows}
        n = 0
        while n < len(self.keys) and (n, self._mark(n)) in known:
            n += 1
        return n

    def _mark(self, step: int) -> str:
        return f"{self.ids[step]}@{self.keys[step]}"

    def state(self) -> str:
        path = f"{self.root}/control/{self.run_id}"
        if not _exists(self.spark, path):
            return "run"
        return self.spark.read.text(path).first()[0]

    def before(self, step: int) -> bool:
        """Whether the run goes on with this step: it has finished before, or nobody has asked the run to pause or stop."""
        return step < self.finished or self.state() == "run"

    def after(self, step: int, frames: list[DataFrame]) -> list[DataFrame]:
        paths = [f"{self.root}/steps/{self.run_id}/{self.keys[step]}/{i}" for i in range(len(frames))]
        if step >= self.finished:
            for frame, path in zip(frames, paths, strict=True):
                frame.write.mode("overwrite").parquet(path)
            runs.save_cursor(self.spark, self.root, self.run_id, step, self._mark(step), step + 1 == len(self.keys))
        return [self.spark.read.schema(frame.schema).parquet(path) for frame, path in zip(frames, paths, strict=True)]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def ask(spark: SparkSession, root: str, run_id: str, state: str) -> None:
    """Ask a run to pause or stop before its next top-level step, or let it run on."""
    if state not in STATES:
        raise ValueError(f"{state!r} is no state of a run ({', '.join(STATES)})")
    spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/control/{run_id}")


def run_recipe(spark: SparkSession, recipe: object, sources: Sources, root: str, run_id: str, columns: list[str] | None = None, robots_rules: list | None = None) -> Run:
    """Carry a recipe out under root, from the step that an earlier call with this run_id has come to.

    A gate that blocks refuses the run. columns: those that the warning about personal data looks at, once, when the run is
    done (by default all that are no mere place); the warning names kinds and counts, no values.
    """
    r = recipe if isinstance(recipe, Recipe) else read_recipe(recipe)
    found = gates(r, robots_rules)
    if blocked := [g["message"] for g in found if g["severity"] == "block"]:
        raise RecipeError("; ".join(blocked))
    store = _Store(spark, root, run_id, r)
    result = compile_recipe(spark, r, sources, store)
    notes = [g["message"] for g in found] + result.notes
    if store.stopped_at is not None:
        state = store.state()
        if state == "stop":
            runs.save_cursor(spark, root, run_id, max(0, store.stopped_at - 1), "stopped", True)
        return Run(result, "stopped" if state == "stop" else "paused", store.stopped_at, None, notes)
    warning = None
    if result.rows is not None:
        names = columns or [c for c, kind in result.rows.dtypes if kind == "string" and not c.startswith("_") and c != "url"]
        warning = run_warning(result.rows, names) if names else None
    return Run(result, "done", len(r.steps), warning, notes)
