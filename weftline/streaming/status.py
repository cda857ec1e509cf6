"""Status events by key: a state machine as a stream and as a batch job, timeouts, snapshots.

An event is (name, version, kind, forced, status, step, error, request_id, at, seq). A ``queue`` event registers its request if there
is no status yet, or one that isn't processing and was last updated before it. A ``begin`` event starts its request: refused,
unless forced, where the status is ready or another request is processing. A ``record`` event sets status, step and error, null
or not; it counts unless it and the status name different requests. Whatever counts raises the sequence, a begin by two: it
registers and then starts. The time of creation is that of the request's registration.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATUS = "name string, version string, status string, step string, error string, request_id string, created_at timestamp, updated_at timestamp, sequence bigint"
_STATE = "status string, step string, error string, request_id string, created_at timestamp, updated_at timestamp, sequence bigint"
FIELDS = ["status", "step", "error", "request_id", "created_at", "updated_at", "sequence"]
KEPT_MS = 24 * 3600 * 1000
QUEUED_MINUTES, QUIET_MINUTES, RUNNING_MINUTES = 20, 30, 375


def _text(x: Any) -> str | None:
    return None if x is None or x != x else x


def fold(state: tuple | None, event: dict) -> tuple | None:
    """The state after one event."""
    kind, request, at = event["kind"], _text(event["request_id"]), event["at"]
    status, holder, updated = (state[0], state[3], state[5]) if state else (None, None, None)
    sequence = state[6] if state else 0
    if kind == "record":
        if state and request and holder and request != holder:
            return state
        return (event["status"], _text(event["step"]), _text(event["error"]), request or holder, state[4] if state else at, at, sequence + 1)
    if state and kind == "queue" and (status == "processing" or at <= updated):
        return state
    if state and kind == "begin" and not event["forced"] and (status == "ready" or (status == "processing" and holder and holder != request)):
        return state
    created = state[4] if state and holder is not None and holder == request else at
    step, more = ("queued", 1) if kind == "queue" else ("workflow-started", 2)
    return ("processing", step, None, request, created, at, sequence + more)


def _after(state: Column, e: Column) -> Column:
    """The same as a column expression: state and e are structs."""
    none, same = state.isNull(), F.coalesce(state["request_id"] == e["request_id"], F.lit(False))
    rival = state["request_id"].isNotNull() & ~same
    queue = none | ((state["status"] != "processing") & (e["at"] > state["updated_at"]))
    begin = none | e["forced"] | ~((state["status"] == "ready") | ((state["status"] == "processing") & rival))
    record = none | e["request_id"].isNull() | ~rival
    sequence, nothing = F.coalesce(state["sequence"], F.lit(0).cast("long")), F.lit(None).cast("string")
    made = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, FIELDS, strict=True)])
    created = F.when(same, state["created_at"]).otherwise(e["at"])
    recorded = made(e["status"], e["step"], e["error"], F.coalesce(e["request_id"], state["request_id"]), F.coalesce(state["created_at"], e["at"]), e["at"], sequence + 1)
    registered = lambda step, more: made(F.lit("processing"), F.lit(step), nothing, e["request_id"], created, e["at"], sequence + more)
    return (
        F.when((e["kind"] == "record") & record, recorded).when((e["kind"] == "queue") & queue, registered("queued", 1))
        .when((e["kind"] == "begin") & begin, registered("workflow-started", 2)).otherwise(state)
    )


def _folded(key: tuple, state: tuple | None, events: pd.DataFrame) -> tuple[tuple | None, pd.DataFrame]:
    for event in events.sort_values(["at", "seq"]).to_dict("records"):
        state = fold(state, event)
    rows = [(*key, *state)] if state else []
    return state, pd.DataFrame(rows, columns=["name", "version", *FIELDS])


def final_status(events: DataFrame) -> DataFrame:
    """The state of every key after all its events, without Python: a key's events come together in one sorted list, which is folded by a column
    expression. Keys are independent; one key's events must fit a task."""
    columns = ["at", "seq", "kind", "forced", "status", "step", "error", "request_id"]
    listed = events.withColumn("forced", F.coalesce("forced", F.lit(False))).groupBy("name", "version").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("events"))
    return listed.select("name", "version", F.reduce("events", F.lit(None).cast(f"struct<{_STATE.replace(' ', ': ').replace(',: ', ', ')}>"), _after).alias("s")).select("name", "version", "s.*")


def status_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: a row with the new state of each key that a trigger's events touch. State is dropped once the events'
    time has gone a day beyond a key's last one (a timeout by processing time would keep an idle stream running batches)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        out = pd.DataFrame(columns=["name", "version", *FIELDS])
        got = list(frames)
        if got:
            now, out = _folded(key, now, pd.concat(got))
        if now:
            state.update(now)
            state.setTimeoutTimestamp(max(int(pd.Timestamp(now[5]).timestamp() * 1000) + KEPT_MS, state.getCurrentWatermarkMs() + 1))
        yield out

    timed = events.withWatermark("at", "1 hour")
    return timed.groupBy("name", "version").applyInPandasWithState(run, STATUS, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def timeout_verdict(status: Column, step: Column, run: Column, age_minutes: Column, has_artifact: Column, runs_active: Column) -> Column:
    """keep, ready or failed for a status that may have stalled. run: null if it has none, else what is known of it: active, success, unknown
    (the look-up failed), or any other end. A status that finalises is looked at elsewhere; runs_active is null where that isn't known."""
    waits = (age_minutes < QUIET_MINUTES) | (F.coalesce(runs_active, F.lit(True)) & (age_minutes < RUNNING_MINUTES))
    return (
        F.when((status != "processing") | F.coalesce(step == "finalizing", F.lit(False)) | (run == "active"), "keep")
        .when(run == "unknown", F.when(age_minutes < RUNNING_MINUTES, "keep").otherwise("failed"))
        .when(run == "success", F.when(has_artifact, "ready").otherwise("failed"))
        .when(run.isNotNull(), "failed")
        .when(age_minutes < QUEUED_MINUTES, "keep").when(has_artifact, "ready").when(waits, "keep").otherwise("failed")
    )


def finalised(status: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Statuses whose last step is finalising become ready once their artifact is there."""
    there = artifacts.select("name", "version", F.lit(True).alias("there")).distinct()
    done = (F.col("status") == "processing") & F.coalesce(F.col("step") == "finalizing", F.lit(False)) & F.coalesce("there", F.lit(False))
    return status.join(there, ["name", "version"], "left").withColumn("status", F.when(done, "ready").otherwise(F.col("status"))).drop("there")


def tree_update(parents: DataFrame, batch: DataFrame) -> DataFrame:
    """Parents (child, parent, edge_seq) after a batch of edges (parent, child, edge_seq): a child's first parent stays."""
    fresh = batch.join(parents.select("child"), "child", "left_anti").groupBy("child").agg(F.min(F.struct("edge_seq", "parent")).alias("m"))
    return parents.unionByName(fresh.select("child", F.col("m.parent").alias("parent"), F.col("m.edge_seq").alias("edge_seq")))
