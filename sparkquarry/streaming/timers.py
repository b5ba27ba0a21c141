"""Keyed streams with event-time timers: buffers that flush by count or by time, silence after an alert, incidents that expire.

Each operator keeps one state row for a key and gives it a timer; when the
watermark passes the timer, the state is flushed, turned or dropped, so state
stays bounded by the keys that were lately active.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .windows import DELAY

SECOND = 1_000_000  # microseconds


def _sorted(parts: Iterator[pd.DataFrame], by: str, *columns: str) -> tuple[np.ndarray, ...]:
    """Times in microseconds and ``columns`` of all rows of a key in a batch, in the order of time and then ``by``; as arrays, since a key has few rows and frames cost more than they."""
    parts = list(parts)
    whole = {c: parts[0][c].to_numpy() if len(parts) == 1 else np.concatenate([p[c].to_numpy() for p in parts]) for c in {"ts", by, *columns}}
    us = whole["ts"].astype("datetime64[us]").astype(np.int64)
    order = np.lexsort((whole[by], us))
    return us[order], *(whole[c][order] for c in columns)


def _timer(state: GroupState, us: int) -> None:
    """Sets the timer to the first millisecond at or after ``us``; one that has passed rings at once."""
    state.setTimeoutTimestamp(max(-(-us // 1000), state.getCurrentWatermarkMs() + 1))


def _time(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def buffered(events: DataFrame, key: str, payload: str, most: int = 100, seconds: int = 5, delay: str = "0 seconds", order: str = "event_id") -> DataFrame:
    """key, tick, block, n, why, events: each flush of a key's buffer.

    A buffer is flushed as soon as it holds ``most`` events (why: count) and,
    if it holds any, at every whole ``seconds`` of event time (why: time).
    ``block`` numbers the flushes between two ticks.  An event that is late,
    but not behind the watermark, joins the open buffer.
    """

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tick, block, held = state.get if state.exists else (None, 0, [])
        held, out = list(held), []

        def flush(why: str) -> None:
            out.append((k[0], _time(tick * seconds * SECOND), block, len(held), why, held))

        if state.hasTimedOut:
            if held:
                flush("time")
            state.remove()
        else:
            us, values = _sorted(parts, order, payload)
            values = values.tolist()
            ticks = us // (seconds * SECOND)
            ticks = np.maximum.accumulate(ticks if tick is None else np.maximum(ticks, tick))
            # the rows of one tick at a time
            cuts = np.flatnonzero(np.diff(ticks)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ticks)]):
                if tick is not None and ticks[lo] != tick:
                    if held:
                        flush("time")
                    block, held = 0, []
                tick = int(ticks[lo])
                held = held + values[lo:hi]
                while len(held) >= most:
                    rest, held = held[most:], held[:most]
                    flush("count")
                    block, held = block + 1, rest
            state.update((tick, block, held))
            _timer(state, (tick + 1) * seconds * SECOND)
        if out:  # most calls only change the state
            yield pd.DataFrame(out, columns=["key", "tick", "block", "n", "why", "events"])

    kinds = dict(events.dtypes)
    found = events.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(
        fold, f"key {kinds[key]}, tick timestamp, block int, n int, why string, events array<{kinds[payload]}>", f"tick long, block int, held array<{kinds[payload]}>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.withColumnRenamed("key", key)


def cooldown(events: DataFrame, key: str, seconds: int, delay: str = DELAY) -> DataFrame:
    """event_id, key, ts of rows let through: none within ``seconds`` of the last one let through for its key, which is forgotten after that time."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        us, ids = _sorted(parts, "event_id", "event_id")
        through, at = [], np.searchsorted(us, state.get[0] + seconds * SECOND) if state.exists else 0
        while at < len(us):  # from one row let through to the next
            through.append(at)
            at = np.searchsorted(us, us[at] + seconds * SECOND)
        last = int(us[through[-1]]) if through else state.get[0]
        state.update((last,))
        _timer(state, last + seconds * SECOND)
        if through:
            yield pd.DataFrame({"event_id": ids[through], "key": [k[0]] * len(through), "ts": us[through].astype("datetime64[us]")})

    kind = dict(events.dtypes)[key]
    found = events.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(fold, f"event_id long, key {kind}, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumnRenamed("key", key)


def incidents(alerts: DataFrame, key: str, severity: str, gap: int, keep: int, delay: str = "0 seconds") -> DataFrame:
    """key, start_at, end_at, n, worst, recurrence: each incident of a key, when ``gap`` seconds have passed without an alert.

    ``recurrence`` counts the incidents of a key; a resolved incident is
    remembered for ``keep`` seconds, after which the key has no state and the
    count begins again.
    """
    columns = ["key", "start_at", "end_at", "n", "worst", "recurrence"]

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, now = [], list(state.get) if state.exists else None  # is_open, start, last, n, worst, recurrence

        def resolve() -> None:
            out.append((k[0], _time(now[1]), _time(now[2]), *now[3:]))
            now[0] = False

        if state.hasTimedOut:
            if now[0]:
                resolve()
            if now[2] + (gap + keep) * SECOND <= state.getCurrentWatermarkMs() * 1000:
                state.remove()
                if out:
                    yield pd.DataFrame(out, columns=columns)
                return
        else:
            us, worst = _sorted(parts, "event_id", severity)
            cuts = np.flatnonzero(np.diff(us) >= gap * SECOND) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(us)]):
                first, last, n, w = int(us[lo]), int(us[hi - 1]), int(hi - lo), float(worst[lo:hi].max())
                if now is not None and now[0] and first - now[2] >= gap * SECOND:
                    resolve()
                if now is not None and now[0]:
                    now = [True, min(now[1], first), max(now[2], last), now[3] + n, max(now[4], w), now[5]]
                else:
                    known = now is not None and first - now[2] < (gap + keep) * SECOND
                    now = [True, first, last, n, w, now[5] + 1 if known else 1]
        state.update(tuple(now))
        _timer(state, now[2] + (gap if now[0] else gap + keep) * SECOND)
        if out:
            yield pd.DataFrame(out, columns=columns)

    kind = dict(alerts.dtypes)[key]
    found = alerts.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(
        fold, f"key {kind}, start_at timestamp, end_at timestamp, n int, worst double, recurrence int", "is_open boolean, start long, last long, n int, worst double, recurrence int", "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.withColumnRenamed("key", key)


def flushed_lines(flushes: DataFrame) -> DataFrame:
    """What a sink gets: a line of JSON for each event of a flush, in order."""
    return flushes.select(F.posexplode("events").alias("at", "value")).select(F.to_json(F.struct("value")).alias("value"))
