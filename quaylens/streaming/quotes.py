"""Quotes as a stream: commands wait until no earlier one can come, apply in order of time, and quotes expire by timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quaylens.operators.quotes import COMMAND, OUTCOME, Quote, commands_of, frame

#: State needs a store that keeps several tables for a key.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_WAITING = "kind string, payload string, price long, eta_days long, valid_seconds long, terms string, expected_revision long, decision string"
_QUOTE = "status string, payload string, revision int, price int, valid_until timestamp"


def _millis(t: pd.Timestamp) -> int:
    """The timer at which a time is over: the next whole millisecond."""
    return -(-pd.Timestamp(t).value // 1_000_000)


class QuoteProcessor(StatefulProcessor):
    """For each quote: its state, the ids it has seen, and commands that wait for the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.quote = handle.getValueState("quote", _QUOTE)
        self.waiting = handle.getMapState("waiting", "at timestamp, command_id string", _WAITING)
        self.seen = handle.getMapState("seen", "command_id string", "once boolean")

    def _load(self) -> Quote:
        if not self.quote.exists():
            return Quote()
        status, payload, revision, price, valid_until = self.quote.get()
        return Quote(status, payload, revision, price, None if valid_until is None else pd.Timestamp(valid_until))

    def _save(self, q: Quote) -> None:
        self.quote.update((q.status, q.payload, q.revision, q.price, None if q.valid_until is None else q.valid_until.to_pydatetime()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        repeats = []
        for pdf in rows:
            for c in commands_of(pdf):
                at = pd.Timestamp(c["at"])
                name = (at.to_pydatetime(), c["command_id"])
                if self.waiting.containsKey(name) or self.seen.containsKey((c["command_id"],)):
                    repeats.append(c)
                    continue
                self.waiting.updateValue(name, tuple(c[k] if k not in _LONGS or c[k] is None else int(c[k]) for k in COMMAND[2:]))
                self.handle.registerTimer(_millis(at))
        if repeats:
            q = self._load()
            yield frame([q.row(key[0], c, "repeated") for c in repeats])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        over, q, out = expiredTimerInfo.getExpiryTimeInMs(), self._load(), []
        due = sorted(name for name in self.waiting.keys() if _millis(name[0]) <= over)  # noqa: SIM118
        for name in due:
            command = dict(zip(COMMAND[2:], self.waiting.getValue(name), strict=True)) | {"at": pd.Timestamp(name[0]), "command_id": name[1]}
            self.waiting.removeKey(name)
            q.seen = {name[1]} if self.seen.containsKey((name[1],)) else set()
            outcome = q.apply(command)
            self.seen.updateValue((name[1],), (True,))
            out.append(q.row(key[0], command, outcome))
            if outcome == "quoted":
                self.handle.registerTimer(_millis(q.valid_until))
        if q.status == "quoted" and q.valid_until is not None and _millis(q.valid_until) == over:
            q_row = q.row(key[0], {"command_id": None, "at": q.valid_until}, "expired")
            out.append((*q_row[:4], "expired", *q_row[5:]))
        self._save(q)
        if out:
            yield frame(out)

    def close(self) -> None:
        pass


_LONGS = {"price", "eta_days", "valid_seconds", "expected_revision"}


def outcomes_of(commands: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The outcomes of a stream of commands, as `operators.quotes.outcomes` has them, for commands that come at most `late` out of order; and a row when a quote expires.

    Run it with STORE set. State of a quote: its last revision, the ids it has seen, and the commands of the last `late`.
    """
    rows = commands.select("quote_id", *COMMAND).withWatermark("at", late)
    return rows.groupBy("quote_id").transformWithStateInPandas(QuoteProcessor(), OUTCOME, "append", "EventTime")
