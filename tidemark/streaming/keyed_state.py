"""Cooldowns and deferred alerts of a stream as keyed state: a value and an event-time timer for each event."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.scores import LEVELS
from tidemark.operators.state import time_to_live

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; one that the session has set itself stays."""
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)


def _millis(t: datetime) -> int:
    return int(t.astimezone(timezone.utc).timestamp() * 1000)


def _highest(rows: Iterator[Row]) -> Row:
    """Of a key's rows in a batch the one that counts: the highest level, then the latest, then the last."""
    return max(rows, key=lambda r: (LEVELS.get(r["level"], -1), r["seen_at"], r["seq"]))


def _set_timer(handle: StatefulProcessorHandle, at: int) -> None:
    """The key's one timer."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at)


COOLED = "event_key string, seq long, level string, seen_level string, repeat_status string, action string, dispatch boolean"


class _Cooldown(StatefulProcessor):
    """State of an event: the level and time it was last seen with; a timer ends it after the level's time to live."""

    def __init__(self, minutes: int, live: dict[str, int]):
        self.minutes, self.live = minutes, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "level string, at long")

    def _status(self, seen_level: str | None, known: bool, level: str | None) -> str:
        if not known or seen_level is None:
            return "new"
        old, new = LEVELS.get(seen_level), LEVELS.get(level)
        if old is None or new is None:
            return "same_event_repeat"
        return "same_level_repeat" if old == new else "meaningful_escalation" if new > old else "deescalation"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best = _highest(rows)
        now, level = _millis(best["seen_at"]), best["level"]
        seen_level, at = self.seen.get() if self.seen.exists() else (None, None)
        known = at is not None and (now - at <= 1000 * self.live.get(seen_level, 0) or seen_level not in self.live)
        status = self._status(seen_level, known, level)
        action = {"new": "allow_new", "meaningful_escalation": "allow_escalation"}.get(status, "cooldown")
        if action == "cooldown" and now - at >= 60_000 * self.minutes:
            action = "allow_new"
        self.seen.update((level, now))
        if level in self.live:
            _set_timer(self.handle, now + 1000 * self.live[level] + 1)
        yield Row(
            event_key=key[0], seq=best["seq"], level=level, seen_level=seen_level if known else None, repeat_status=status, action=action,
            dispatch=action != "cooldown" and level in ("alert", "urgent"),
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.seen.clear()
        return iter(())


def cooling(stream: DataFrame, late: str = "10 minutes", minutes: int = 240, live: dict[str, int] | None = None) -> DataFrame:
    """What each event (event_key, level, seen_at, seq) of a stream asks for, from what was last seen of it.

    State is a value for each key, kept by the state store with the stream's checkpoint: a batch reads and writes only
    the keys that it has, and a timer drops a key once the watermark, late behind the latest event, passes its last
    event's time to live (seconds for each level; never less than the cooldown). Of a key's rows in a batch the highest
    level counts, then the latest, then the last; the decision is taken at its own time. Decisions are those of the
    batch operator state.cooldowns over state without what has expired, and state becomes what it gives to
    state.merged_state. Rows behind the watermark are dropped. A level that isn't known never expires. Keys and times
    must not be null.
    """
    use_rocksdb(stream.sparkSession)
    of_key = stream.select("event_key", "level", "seen_at", "seq").withWatermark("seen_at", late).groupBy("event_key")
    return of_key.transformWithState(_Cooldown(minutes, live or time_to_live(minutes)), COOLED, "Append", "EventTime")


DEFERRED = "event_key string, entry_id string, level string, deferred_at timestamp, outcome string"


class _Deferred(StatefulProcessor):
    """State of an event: its deferred entry; it leaves by a flush, or by a timer when its hours are over."""

    def __init__(self, hours: int):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", "entry_id string, level string, at long")

    def _leaves(self, key: str, outcome: str) -> Row:
        entry_id, level, at = self.entry.get()
        self.entry.clear()
        return Row(event_key=key, entry_id=entry_id, level=level, deferred_at=datetime.fromtimestamp(at / 1000, timezone.utc), outcome=outcome)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        timed = False
        for row in sorted(rows, key=lambda r: (r["seen_at"], r["seq"])):
            now = _millis(row["seen_at"])
            if self.entry.exists() and now - self.entry.get()[2] > 3_600_000 * self.hours:
                yield self._leaves(key[0], "expired")
            if row["flush"]:
                if self.entry.exists():
                    yield self._leaves(key[0], "flushed")
                continue
            entry_id, level, at = self.entry.get() if self.entry.exists() else (row["entry_id"], None, now)
            if level is None or LEVELS.get(row["level"], -1) >= LEVELS.get(level, -1):
                level = row["level"]
            self.entry.update((entry_id, level, at))
            timed = True
        if self.entry.exists() and timed:
            _set_timer(self.handle, self.entry.get()[2] + 3_600_000 * self.hours + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.entry.exists() and self.entry.get()[2] + 3_600_000 * self.hours < expiredTimerInfo.getExpiryTimeInMs():
            yield self._leaves(key[0], "expired")


def deferring(stream: DataFrame, late: str = "10 minutes", hours: int = 12) -> DataFrame:
    """Deferred alerts of a stream (event_key, entry_id, level, seen_at, seq, flush) as they leave: flushed or expired.

    A key has one entry: its first entry_id and time, and the highest level since. A row with flush takes it out. One
    older than hours expires, at the key's next row or, without one, when the watermark passes. Rows of a key in a batch
    count in order of time and seq.
    """
    use_rocksdb(stream.sparkSession)
    of_key = stream.select("event_key", "entry_id", "level", "seen_at", "seq", "flush").withWatermark("seen_at", late).groupBy("event_key")
    return of_key.transformWithState(_Deferred(hours), DEFERRED, "Append", "EventTime")
