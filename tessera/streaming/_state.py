"""The stateful step of the turn stream: events held per invocation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class HeldTurns(StatefulProcessor):
    """Holds an invocation's events (``ev``, JSON) until a row with the hook
    ``after_agent``, or until ``timeout_ms`` of event time after the last event."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "ev string")

    def handleInputRows(self, key, rows, timerValues):
        new, ended, last = [], False, None
        for pdf in rows:
            new.extend(pdf["ev"].tolist())
            ended = ended or bool((pdf["hook"] == "after_agent").any())
            top = pdf["ts"].max()
            last = top if last is None or top > last else last
        if ended:
            yield self.release(key, new)
        else:
            self.events.appendList([(e,) for e in new])
            self.drop_timers()
            at = max(int(last.timestamp() * 1000), timerValues.getCurrentWatermarkInMs())
            self.handle.registerTimer(at + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self.release(key, [])

    def release(self, key, new: list) -> pd.DataFrame:
        held = [r[0] for r in self.events.get()] if self.events.exists() else []
        self.events.clear()
        self.drop_timers()
        held += new
        return pd.DataFrame({"invocation_id": [key[0]] * len(held), "ev": held})

    def drop_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)

    def close(self) -> None:
        pass
