"""State tables that a rerun, a crash or a replayed micro-batch cannot count twice.

A log lies in one folder: ``rows/slot=N`` holds what one run added, ``base/slot=0|1`` all earlier runs folded together, and
``pointer/slot=0|1`` a manifest of one row. A run writes its rows first and is committed by the manifest that names it; readers see only
what the newest manifest names. So a run that broke off is invisible, and one that comes again under its id changes nothing.

Every ``every`` runs the log is compacted: base and open runs are folded into the other base slot, then a new manifest names that one.
A crash before the manifest leaves the old state, one after it the new; nothing is lost or doubled. Slots are used in turn, each
overwritten when its rows have long been folded, so a log keeps ``2 * every + 4`` folders however many runs it has seen. Manifests are
written to their two slots in turn as well: the one that is not being written is whole.

One writer at a time; readers may come at any time, and finish before ``every`` more runs have been committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_MANIFEST = "version long, base int, next int, open array<struct<run:string,slot:int>>, folded array<string>, whole boolean"


class StateLog:
    """``fold`` reduces a table of runs' rows to the current state, with the same columns; folding a state and further rows must
    give what folding all rows gives, as newest-N, latest-per-key and exact totals do."""

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], every: int = 20) -> None:
        self.spark, self.path, self.fold, self.every = spark, path.rstrip("/"), fold, every

    def manifest(self) -> dict:
        """The newest whole manifest; an empty one for a new log."""
        found = []
        for slot in (0, 1):
            try:
                found += self.spark.read.schema(_MANIFEST).json(f"{self.path}/pointer/slot={slot}").where("whole").collect()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        if not found:
            return {"version": 0, "base": -1, "next": 0, "open": [], "folded": []}
        row = max(found, key=lambda r: r["version"])
        return {**row.asDict(), "open": [(o["run"], o["slot"]) for o in row["open"]]}

    def _switch(self, state: dict) -> None:
        """Make ``state`` the newest manifest: one row in one file, in the slot of the older one."""
        version = state["version"] + 1
        row = (version, state["base"], state["next"], state["open"], state["folded"], True)
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/pointer/slot={version % 2}")

    def _rows(self, state: dict) -> DataFrame | None:
        paths = [f"{self.path}/rows/slot={slot}" for _, slot in state["open"]]
        paths += [f"{self.path}/base/slot={state['base']}"] if state["base"] >= 0 else []
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def append(self, rows: DataFrame, run: str) -> bool:
        """Add a run's rows; false, and nothing happens, if a run of that id is committed."""
        state = self.manifest()
        if run in state["folded"] or run in {r for r, _ in state["open"]}:
            return False
        slot = state["next"]
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/slot={slot}")
        self._switch({**state, "next": (slot + 1) % (2 * self.every), "open": [*state["open"], (run, slot)]})
        if len(state["open"]) + 1 >= self.every:
            self.compact()
        return True

    def compact(self) -> None:
        """Fold all committed runs into the other base slot, then point to it."""
        state = self.manifest()
        rows = self._rows(state)
        if rows is None or not state["open"]:
            return
        base = 1 - max(state["base"], 0)
        self.fold(rows).write.mode("overwrite").parquet(f"{self.path}/base/slot={base}")
        self._switch({**state, "base": base, "open": [], "folded": [*state["folded"], *(r for r, _ in state["open"])]})

    def read(self, schema: str | None = None) -> DataFrame:
        """The current state. ``schema``: the columns of a log without runs."""
        rows = self._rows(self.manifest())
        if rows is None:
            if schema is None:
                raise ValueError(f"no run is committed in {self.path}")
            return self.spark.createDataFrame([], schema)
        return self.fold(rows)


def run_id() -> str:
    """A fresh id, for runs that are not named by their caller."""
    return uuid.uuid4().hex
