"""The newest observation of each key as a stream, with what was turned away: older rows, repeats, and other prices of the same time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quaylens.streaming.observations import not_ahead

OUTCOME = "event_id long, observed_at timestamp, price double, outcome string, revision long"
_HELD = "observed_at timestamp, event_id long, price double, revision long"


class NewestProcessor(StatefulProcessor):
    """Keeps a key's newest row until the watermark is `keep_ms` past it, then forgets the key."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)

    def _until(self, observed_at: pd.Timestamp) -> int:
        return pd.Timestamp(observed_at).value // 1_000_000 + self.keep_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        at, event, price, revision = self.held.get() if self.held.exists() else (None, None, None, 0)
        before = at
        at = None if at is None else pd.Timestamp(at)
        for pdf in rows:
            out = []
            for r in pdf.sort_values("event_id").itertuples():
                value = None if pd.isna(r.price) else float(r.price)
                if at is None or r.observed_at > at:
                    outcome, at, event, price, revision = "accepted", r.observed_at, int(r.event_id), value, revision + 1
                elif r.observed_at < at:
                    outcome = "rejected_older"
                else:
                    outcome = "duplicate" if value == price else "equal_time_conflict"
                out.append((*key, int(r.event_id), r.observed_at, value, outcome, revision))
            yield pd.DataFrame(out, columns=[*self.names, "event_id", "observed_at", "price", "outcome", "revision"])
        if at is not None and (before is None or at > pd.Timestamp(before)):
            if before is not None:
                self.handle.deleteTimer(self._until(before))
            self.handle.registerTimer(self._until(at))
            self.held.update((at.to_pydatetime(), event, price, revision))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def newest_with_outcomes(stream: DataFrame, key: str, late: str = "1 hour", keep_seconds: int = 86_400) -> DataFrame:
    """What became of each observation as it arrived: accepted, rejected_older, duplicate or equal_time_conflict, and how many of its key were accepted by then.

    Rows with outcome accepted are the newest-wins table's changes, the others the second output. Rows older than the watermark are
    dropped by Spark, those from the future by `not_ahead`. State is one row for a key, and goes once the watermark is keep_seconds past it;
    a key that is seen after that starts anew. Within a batch rows of a key go by event_id. Run it with `quotes.STORE` set.
    """
    processor = NewestProcessor(keep_seconds * 1000)
    processor.names = [key]
    kind = stream.schema[key].dataType.simpleString()
    rows = not_ahead(stream).where(f"{key} is not null and observed_at is not null").select(key, "event_id", "observed_at", "price").withWatermark("observed_at", late)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {OUTCOME}", "append", "EventTime")
