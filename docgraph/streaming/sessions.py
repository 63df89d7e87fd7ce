"""Session memory and session windows over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import BUFFER_LIMIT, MESSAGE, NOTE, NOTE_SIMILARITY, REFLECT_EVERY, TTL_SECONDS

OUTPUT = "session_id string, turns long, reflections long, n_buffer int, n_notes int, last_ts double"
_NUMBERS = "turns long, reflections long, last_ts double"
_MESSAGE, _NOTE = (kind[len("struct<") : -1].replace(":", " ") for kind in (MESSAGE, NOTE.replace("array<string>", "array[string]")))


class SessionMemory(StatefulProcessor):
    """Keyed memory of a session: the same rules as the batch fold, with a state that expires.

    Buffer and notes are lists in the store: messages and notes are appended, and the buffer is written anew only where it is halved.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", _NUMBERS)
        self.buffer = handle.getListState("buffer", _MESSAGE)
        self.notes = handle.getListState("notes", _NOTE.replace("array[string]", "array<string>"))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        saved = json.loads(initialState["state"].iloc[0] or "{}")
        buffer = [(m.get("turn"), m.get("id"), m.get("role"), m.get("content"), m.get("ts")) for m in saved.get("buffer") or ()]
        notes = [(n.get("text"), n.get("turn_ids"), n.get("ts")) for n in saved.get("notes") or ()]
        times = [x[-1] for x in (*buffer, *notes) if x[-1] is not None]
        if buffer:
            self.buffer.put(buffer)
        if notes:
            self.notes.put(notes)
        self.numbers.update((0, 0, max(times, default=None)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, reflections, last = self.numbers.get() if self.numbers.exists() else (0, 0, None)
        buffer = [tuple(m) for m in self.buffer.get()] if self.buffer.exists() else []
        notes = [(n[0], list(n[1]), n[2]) for n in self.notes.get()] if self.notes.exists() else []
        stored, stored_notes = len(buffer), len(notes)  # how much of them the store has; -1: to be written anew
        arrived = pd.concat(list(rows)).sort_values("turn", kind="stable")
        for m in arrived.itertuples(index=False):
            if last is not None and m.ts_seconds - last > TTL_SECONDS:
                buffer, notes, turns, reflections, stored, stored_notes = [], [], 0, 0, -1, -1
            last = float(m.ts_seconds)
            buffer.append((int(m.turn), m.id, m.role, m.content, last))
            if m.role not in ("user", "assistant"):
                continue
            turns += 1
            if turns % REFLECT_EVERY == 0 or len(buffer) > BUFFER_LIMIT:
                half = max(1, len(buffer) // 2)
                text = "\n".join(f"{role.upper()}: {content}" for _, _, role, content, _ in buffer[:half]).strip(" ")
                notes = _distinct([*notes, (text, [x[1] for x in buffer[:half]], last)])
                buffer, reflections, stored = buffer[half:], reflections + 1, -1
        _store(self.buffer, buffer, stored)
        _store(self.notes, notes, stored_notes)
        self.numbers.update((turns, reflections, last))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((last + TTL_SECONDS) * 1000) + 1)
        yield pd.DataFrame(
            {"session_id": [key[0]], "turns": [turns], "reflections": [reflections], "n_buffer": [len(buffer)], "n_notes": [len(notes)], "last_ts": [last]}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.numbers, self.buffer, self.notes):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _store(state, values: list[tuple], stored: int) -> None:
    """Makes a list of the store hold ``values``, of which it has the first ``stored``; -1: none that counts."""
    if stored < 0 and not values:
        state.clear()
    elif stored < 0:
        state.put(values)
    elif len(values) > stored:
        state.appendList(values[stored:])


def _distinct(notes: list[tuple]) -> list[tuple]:
    kept: list[tuple] = []
    for note in notes:
        own = set(note[0].lower().split())
        sets = [set(n[0].lower().split()) for n in kept]
        if all(not own or not s or len(own & s) / len(own | s) < NOTE_SIMILARITY for s in sets):
            kept.append(note)
    return kept


def stream_session_memory(messages: DataFrame, lateness: str = "10 minutes", saved: DataFrame | None = None) -> DataFrame:
    """(session_id, turns, reflections, n_buffer, n_notes, last_ts): a row per session at each arrival, in update mode.

    messages: a stream of (session_id, turn, id, role, content, ts timestamp). The state of a session that was silent for an
    hour of event time is dropped. ``saved`` (session_id, state), as ``save_sessions`` gives it, is what sessions start from. Needs the RocksDB state store.
    """
    rows = messages.withWatermark("ts", lateness).withColumn("ts_seconds", F.col("ts").cast("double"))
    start = None if saved is None else saved.select("session_id", "state").groupBy("session_id")
    return rows.groupBy("session_id").transformWithStateInPandas(SessionMemory(), OUTPUT, "Update", "EventTime", start)


def stream_sessions(events: DataFrame, key: str, lateness: str = "10 minutes", gap: str = "1 hour") -> DataFrame:
    """(key, start, end, n): activity sessions of a stream of (key, ts), closed after ``gap`` without events; append mode."""
    windows = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return windows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
