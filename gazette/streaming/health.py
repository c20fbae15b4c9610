"""Sources' health over a stream of attempts: typed state for each source, folded attempt by attempt, and alerts that open and close once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.health import ALERT, BREAK, HISTORY, LEAST

OUTPUT = (
    "source string, attempt long, state string, consecutive_failures int, baseline double, needs_alert boolean, alert string, alert_since long, counts array<double>"
)
#: What a query can start from: a row for each source.
SNAPSHOT = ("source", "state", "consecutive_failures", "alert_since", "counts")
DISABLED, OPENED, CLOSED = "disabled", "opened", "closed"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(state: dict, ok: bool, items: float, primary: bool) -> dict:
    """The state after one more attempt. `disabled` is for a person to set and stays."""
    if state.get("state") == DISABLED:
        return state
    counts = state.get("counts", [])
    if not ok:
        return {"state": "failed", "failures": state.get("failures", 0) + 1, "counts": counts}
    base = median(counts) if len(counts) >= LEAST else None
    broken = base is not None and base > 0 and items < base * BREAK
    return {"state": "healthy" if primary and not broken else "degraded", "failures": 0, "counts": [*counts, items][-HISTORY:]}


class Health(StatefulProcessor):
    """One source's state: `status` (state, failures in a row, since which attempt an alert is open) and `counts` (the last successful ones)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "state string, failures int, alert_since long")
        self.counts = handle.getListState("counts", "items double")

    def _load(self) -> tuple[dict, int | None]:
        if not self.status.exists():
            return {}, None
        state, failures, since = self.status.get()
        return {"state": state, "failures": failures, "counts": [x[0] for x in self.counts.get()] if self.counts.exists() else []}, since

    def _save(self, state: dict, since: int | None) -> None:
        self.status.update((state["state"], state.get("failures", 0), since))
        if state.get("counts"):
            self.counts.put([(float(x),) for x in state["counts"]])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, since = self._load()
        out = []
        # One source's attempts of one trigger; they come in any order.
        for r in pd.concat(list(rows)).sort_values("attempt").itertuples():
            state = fold(state, bool(r.ok), float(r.items) if r.ok else 0.0, bool(r.primary))
            failures, counts = state.get("failures", 0), state.get("counts", [])
            wants = state["state"] != DISABLED and failures >= ALERT
            event = OPENED if wants and since is None else CLOSED if not wants and since is not None and state["state"] != DISABLED else None
            since = int(r.attempt) if event == OPENED else None if event == CLOSED else since
            base = float(median(counts)) if len(counts) >= LEAST else None
            out.append((key[0], int(r.attempt), state["state"], failures, base, wants, event, since, None))
        self._save(state, since)
        out[-1] = (*out[-1][:-1], [float(x) for x in state.get("counts", [])])
        names = ["source", "attempt", "state", "consecutive_failures", "baseline", "needs_alert", "alert", "alert_since", "counts"]
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({"alert_since": "Int64"})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = next(initialState.itertuples())
        since = None if pd.isna(r.alert_since) else int(r.alert_since)
        self._save({"state": r.state, "failures": int(r.consecutive_failures), "counts": list(r.counts) if r.counts is not None else []}, since)

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """Typed state needs the RocksDB store; queries that start within this have it, and the session's setting is put back."""
    _ = spark.streams  # whoever has not used streams yet has no coordinator of state stores, which tables need as well
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def source_health(attempts: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """The state after each attempt of a stream, or of a table (source, attempt, ok, items, primary); `attempt` orders a source's attempts.

    alert is `opened` at the attempt that makes a streak of ALERT failures, and `closed` at the success that ends it, once each;
    between them alert_since says at which attempt it opened. initial: a snapshot() to go on from. counts, on the last attempt of each
    source and trigger, is what snapshot() needs. Queries over this are to be started within state_store().
    """
    rows = attempts.select(F.col("source").cast("string").alias("source"), F.col("attempt").cast("long").alias("attempt"), "ok", F.col("items").cast("double").alias("items"), "primary")
    start = None if initial is None else initial.select(*SNAPSHOT).groupBy("source")
    return rows.groupBy("source").transformWithStateInPandas(Health(), OUTPUT, "append", "none", initialState=start)


def snapshot(states: DataFrame) -> DataFrame:
    """SNAPSHOT: the last state of each source, of all that source_health() has told."""
    last = F.max_by(F.struct("state", "consecutive_failures", "alert_since", "counts"), "attempt").alias("s")
    return states.filter("counts is not null").groupBy("source").agg(last).select("source", "s.*")


def open_alerts(states: DataFrame) -> DataFrame:
    """(source, alert_since, consecutive_failures) of the sources whose alert is open."""
    return snapshot(states).filter("alert_since is not null").select("source", "alert_since", "consecutive_failures")
