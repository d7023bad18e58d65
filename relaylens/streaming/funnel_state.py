"""The state machine of the streaming funnel (F4, and F2 with two steps).

Self-contained on purpose (numpy, pandas and pyspark only): the module is
registered with cloudpickle to be pickled by value, so Python workers run
the processor without importing this package — on a cluster they need
nothing shipped beyond the query itself.

Events become final once the watermark has passed them: Spark drops any
later arrival older than the watermark.  So the processor advances the
funnel in event-time order over final events only.  A key holds a bucket of
users in one time slice, and keeps for them:

* ``events``: the events not yet final (about the watermark delay's worth),
  an array per column for each batch they came in;
* ``sends``: the open sends with the stage each has reached and the times of
  the steps matched so far, an array per column;
* ``timer``: one event-time timer, at the first moment something can move
  (the earliest buffered event or the earliest window end becomes final).

State calls and timers cost a round trip each, so there are as many of them
as keys, not as users, and what a call carries are whole columns.

The greedy chain is advanced a stage at a time, for all users of the key in
one ``numpy.searchsorted``: the first event of step ``j`` of the send's user
strictly after the time of step ``j - 1``.  Processing in time order makes
this exact: an event of step ``j`` after a send's step ``j - 1`` is never
final before that step was matched.  A send is emitted when every event up to
its window end is final.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_EVENT_COLS = ["user_id", "event_id", "us", "step", "campaign_id"]
_TIMER = T.StructType([T.StructField("at_ms", T.LongType())])
#: Stands for null in the arrays of the state: a missing campaign, a step not
#: yet reached.
NO_VALUE = -(1 << 63)


def _arrays(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in names])


def _column(values: pd.Series) -> np.ndarray:
    return values.astype("Int64").fillna(NO_VALUE).to_numpy(dtype=np.int64)


def _stacked(names: list[str], parts: list[tuple]) -> dict[str, np.ndarray]:
    """Rows of arrays, one under the other."""
    none = np.empty(0, np.int64)
    return {n: np.concatenate([none, *(np.array(p[i], np.int64) for p in parts)]) for i, n in enumerate(names)}


def _taken(rows: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {n: v[which] for n, v in rows.items()}


def _value(names: list[str], rows: dict[str, np.ndarray]) -> tuple:
    return tuple(rows[n].tolist() for n in names)


def _after_ms(us: int) -> int:
    """The first whole millisecond at which a watermark lies past ``us``."""
    return us // 1000 + 1


class FunnelProcessor(StatefulProcessor):
    def __init__(self, n_steps: int, window_us: int):
        self.k = n_steps - 1
        self.window_us = window_us
        self.send_cols = ["user_id", "send_id", "t0", "campaign_id", "stage"] + [f"u{j}" for j in range(1, self.k + 1)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _arrays(_EVENT_COLS))
        self.sends = handle.getValueState("sends", _arrays(self.send_cols))
        self.timer = handle.getValueState("timer", _TIMER)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Open sends that a batch run hands over (a key may come in parts)."""
        held = self.sends.get()
        new = {n: _column(initialState[n]) for n in self.send_cols}
        sends = _stacked(self.send_cols, [*([held] if held else []), tuple(new.values())])
        self.sends.update(_value(self.send_cols, sends))
        self._arm(_after_ms(int(new["t0"].min()) + self.window_us))

    def _arm(self, at: int) -> None:
        """Set the key's timer, unless an earlier one is set."""
        cur = self.timer.get()
        if cur is None or at < cur[0]:
            if cur is not None:
                self.handle.deleteTimer(cur[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            part = {n: _column(pdf[n]) for n in _EVENT_COLS}
            self.events.appendValue(_value(_EVENT_COLS, part))
            m = int(part["us"].min())
            first = m if first is None else min(first, m)
        if first is not None:
            self._arm(_after_ms(first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        wm_us = timerValues.getCurrentWatermarkInMs() * 1000
        buf = _stacked(_EVENT_COLS, list(self.events.get()))
        held = self.sends.get()
        sends = _stacked(self.send_cols, [held] if held else [])
        past = buf["us"] < wm_us
        final, rest = _taken(buf, past), _taken(buf, ~past)

        new = _taken(final, final["step"] == 0)
        n_new = len(new["us"])
        if n_new:
            fresh = {"user_id": new["user_id"], "send_id": new["event_id"], "t0": new["us"], "campaign_id": new["campaign_id"]}
            fresh["stage"] = np.zeros(n_new, np.int64)
            fresh |= {f"u{j}": np.full(n_new, NO_VALUE, np.int64) for j in range(1, self.k + 1)}
            sends = {n: np.concatenate([sends[n], fresh[n]]) for n in self.send_cols}
        out, moved = None, n_new > 0
        if len(sends["t0"]):
            moved |= self._advance(sends, final)
            due = sends["t0"] + self.window_us < wm_us
            if due.any():
                out, moved = self._emit(_taken(sends, due)), True
                sends = _taken(sends, ~due)

        # state is written only where it changed: steps that reached no send
        # leave the sends as they are, and a timer for a window end alone
        # leaves the events
        if past.any():
            self.events.put([_value(_EVENT_COLS, rest)]) if len(rest["us"]) else self.events.clear()
        if moved:
            self.sends.update(_value(self.send_cols, sends)) if len(sends["t0"]) else self.sends.clear()
        nxt = []
        if len(rest["us"]):
            nxt.append(_after_ms(int(rest["us"].min())))
        if len(sends["t0"]):
            nxt.append(_after_ms(int(sends["t0"].min()) + self.window_us))
        if nxt:  # the timer that fired is gone; arm the next one
            at = min(nxt)
            self.handle.registerTimer(at)
            self.timer.update((at,))
        else:
            self.timer.clear()
        return iter([out]) if out is not None else iter([])

    def _advance(self, sends: dict[str, np.ndarray], final: dict[str, np.ndarray]) -> bool:
        """Move the sends on by the final events; whether any moved."""
        moved = False
        end = sends["t0"] + self.window_us
        for j in range(1, self.k + 1):
            step, at = final["step"] == j, np.flatnonzero(sends["stage"] == j - 1)
            if not step.any() or not len(at):
                continue
            times = final["us"][step]
            prev = sends["t0" if j == 1 else f"u{j - 1}"][at]
            # one ascending number for (user, time): all times of a key lie
            # within a slice and a window of each other
            users, code = np.unique(np.concatenate([final["user_id"][step], sends["user_id"][at]]), return_inverse=True)
            low = min(times.min(), prev.min())
            span = max(times.max(), prev.max()) - low + 1
            place = np.sort(code[: len(times)] * span + (times - low))
            own = code[len(times) :]
            idx = np.searchsorted(place, own * span + (prev - low), side="right")  # first strictly later
            hit = place[np.minimum(idx, len(place) - 1)]
            time = hit % span + low
            ok = (idx < len(place)) & (hit // span == own) & (time <= end[at])
            if ok.any():
                moved = True
                sends[f"u{j}"][at[ok]] = time[ok]
                sends["stage"][at[ok]] = j
        return moved

    def _emit(self, done: dict[str, np.ndarray]) -> pd.DataFrame:
        def nullable(name: str, dtype: str) -> pd.Series:
            return pd.Series(done[name]).astype("Int64").mask(done[name] == NO_VALUE).astype(dtype)

        return pd.DataFrame(
            {
                "send_id": done["send_id"],
                "user_id": done["user_id"],
                "campaign_id": nullable("campaign_id", "Int32"),
                "send_us": done["t0"],
                **{f"u{j}": nullable(f"u{j}", "Int64") for j in range(1, self.k + 1)},
                "depth": done["stage"].astype(np.int32),
            }
        )

    def close(self) -> None:
        pass


cloudpickle.register_pickle_by_value(sys.modules[__name__])
