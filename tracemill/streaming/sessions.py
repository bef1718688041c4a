"""Live sessions: the same assembly as a stateful stream, a row for each session some time after it has ended or gone idle.

A session's events are a list in the state store: a batch appends its own events and reads the others only when the
session's row is made, so the work for a session grows with its events and not with the square of their number. The row
is made when the watermark passes a timer: ratings and reports that follow an end, and events that come late, are in it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions.fixed import OUTCOME_TAGS, PAIN_POINT_CATEGORIES, SEVERITIES, TOOL_STATUSES, TOOL_TEXT
from ..operators.sessions import ASSISTANT, HUMAN, SESSION

_EVENT = StructType([StructField("event", StringType())])
#: Milliseconds of a session's newest event, and whether it has ended.
_SEEN = StructType([StructField("last", LongType()), StructField("ended", BooleanType())])
#: The stateful operator keeps lists only in this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value):
    """Values of a pandas cell as Python's own: null for what is missing, dicts for rows, text for times."""
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if hasattr(value, "tolist") and not isinstance(value, pd.Timestamp):
        value = value.tolist()
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    return value.isoformat() if isinstance(value, pd.Timestamp) else value


def _whole(value) -> int | None:
    return None if value is None else int(value)


def _turn(e: dict) -> dict | None:
    if e["role"] not in HUMAN + ASSISTANT or e["content"] is None:
        return None
    calls = []
    for c in e["tool_calls"] or []:
        if c["name"] is None or c["status"] is not None and c["status"] not in TOOL_STATUSES:
            return None
        calls.append({"tool_name": c["name"], "tool_input": (c["input"] or "")[:TOOL_TEXT], "tool_output": (c["output"] or "")[:TOOL_TEXT], "tool_status": c["status"] or "success", "latency_ms": _whole(c["latency_ms"])})
    return {"from": "human" if e["role"] in HUMAN else "gpt", "value": e["content"], "tool_calls": calls or None, "token_count": _whole(e["token_count"]), "generation_latency_ms": _whole(e["latency_ms"])}


def _row(key: str, events: list[dict]) -> dict:
    starts = [e for e in events if e["kind"] == "start"]
    begin = max(starts, key=lambda e: e["seq"]) if starts else None
    turns, reports, rated = [], [], None
    for e in events:
        if begin is not None and e["seq"] < begin["seq"]:
            continue
        if e["kind"] == "turn" and (turn := _turn(e)) is not None:
            turns.append(turn)
        elif e["kind"] == "rate" and e["rating"] is not None and 1 <= e["rating"] <= 5 and all(t in OUTCOME_TAGS for t in e["tags"] or []):
            rated = e
        elif e["kind"] == "report" and e["category"] in PAIN_POINT_CATEGORIES and (e["severity"] or "medium") in SEVERITIES and e["description"] is not None:
            reports.append({"category": e["category"], "severity": e["severity"] or "medium", "description": e["description"], "turn_index": max(0, len(turns) - 1), "reproducible": None})
    model = begin and begin["model"]
    if model:
        model = model | {"model_name": model["model_name"] or "unknown", "context_used": None}
    return {
        "session_id": key,
        "conversations": turns,
        "user_rating": rated and int(rated["rating"]),
        "outcome_tags": rated and (rated["tags"] or []),
        "user_comment": rated and (rated["comment"] or None),
        "pain_points": reports,
        "model": model,
        "hardware": begin and begin["hardware"],
        "created_at": pd.Timestamp(begin["at"]) if begin and begin["at"] else pd.NaT,
        "ended": any(e["kind"] == "end" for e in events if begin is None or e["seq"] >= begin["seq"]),
    }


class Assembly(StatefulProcessor):
    """Appends each event to its session's list. A timer of event time, grace_ms after a session's last event if it has ended and idle_ms if it hasn't, gives its row and clears the list."""

    def __init__(self, grace_ms: int, idle_ms: int):
        self.grace_ms, self.idle_ms = grace_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.events = handle, handle.getListState("events", _EVENT)
        self.seen = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [{k: _plain(v) for k, v in r.items()} for frame in rows for r in frame.to_dict("records")]
        last, ended = self.seen.get() or (0, False)
        last = max([last, *(int(pd.Timestamp(e["at"]).value // 1_000_000) for e in new if e["at"] is not None)])
        ended = bool(ended) or any(e["kind"] == "end" for e in new)
        self.seen.update((last, ended))
        self.events.appendList([(json.dumps(e),) for e in new])
        for timer in self._timers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last + (self.grace_ms if ended else self.idle_ms), timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def _timers(self) -> list[int]:
        return [t[0] if isinstance(t, tuple | list) else t for t in self.handle.listTimers()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted((json.loads(x[0]) for x in self.events.get()), key=lambda e: e["seq"])
        self.events.clear()
        self.seen.clear()
        if held:
            yield pd.DataFrame([_row(key[0], held)])

    def close(self) -> None:
        pass


def assemble_stream(events: DataFrame, delay: str = "10 minutes", grace_ms: int = 3600 * 1000, idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """events: a stream with the columns of operators.sessions.EVENT, `at` (UTC) in each -> one row (SESSION) for each life of a session.

    A session's life is over when no event of it is younger than grace_ms after an end, or than idle_ms without one, by
    event time: then its row comes, with `ended` false for those that only went idle. Rows hold all events of the life in
    the order of seq, as operators.sessions.assemble() gives them, whichever batches they came in; later events begin a
    new life. Events more than `delay` behind the newest one count as too late once their batch is over, and Spark drops
    them. The session has to be set to the state store ROCKSDB.
    """
    return events.withWatermark("at", delay).groupBy("session_id").transformWithStateInPandas(Assembly(grace_ms, idle_ms), outputStructType=SESSION, outputMode="append", timeMode="EventTime")
