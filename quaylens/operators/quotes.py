"""Quotes: requests, priced revisions and decisions, folded from commands under compare-and-set rules.

A command has quote_id, command_id, at, kind (request, quote, decide) and what its kind needs: payload; price (halalas), eta_days,
valid_seconds, terms, expected_revision (null: any); decision, expected_revision. Commands of a quote apply by time, then by id. One with an id that was
applied before is a repeat and does nothing; a second request with the same payload is replayed, with another a conflict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bounds of a quote.
MOST_PRICE, MOST_DAYS, LEAST_SECONDS, MOST_SECONDS, MOST_TERMS = 999_999_999, 90, 60, 2_592_000, 1000
COMMAND = ["command_id", "at", "kind", "payload", "price", "eta_days", "valid_seconds", "terms", "expected_revision", "decision"]
OUTCOME = "quote_id string, command_id string, at timestamp, outcome string, status string, revision int, price int, valid_until timestamp"


@dataclass
class Quote:
    status: str | None = None
    payload: str | None = None
    revision: int = 0
    price: int | None = None
    valid_until: pd.Timestamp | None = None
    seen: set[str] = field(default_factory=set)

    def apply(self, command: dict) -> str:
        """Changes the quote if the rules allow it; gives the outcome."""
        if command["command_id"] in self.seen:
            return "repeated"
        self.seen.add(command["command_id"])
        return {"request": self._request, "quote": self._quote, "decide": self._decide}.get(command["kind"], lambda _: "unknown_command")(command)

    def _request(self, c: dict) -> str:
        if c["payload"] is None:
            return "invalid_request"
        if self.status is not None:
            return "replayed" if c["payload"] == self.payload else "payload_conflict"
        self.status, self.payload = "requested", c["payload"]
        return "requested"

    def _quote(self, c: dict) -> str:
        price, days, seconds, terms = c["price"], c["eta_days"], c["valid_seconds"], (c["terms"] or "").strip()
        sound = None not in (price, days, seconds) and 1 <= price <= MOST_PRICE and 0 <= days <= MOST_DAYS and LEAST_SECONDS <= seconds <= MOST_SECONDS
        if not sound or not 0 < len(terms) <= MOST_TERMS or (c["expected_revision"] is not None and c["expected_revision"] < 0):
            return "invalid_quote"
        if self.status not in ("requested", "quoted") or c["expected_revision"] not in (None, self.revision):
            return "not_mutable"
        self.status, self.revision, self.price = "quoted", self.revision + 1, int(price)
        self.valid_until = c["at"] + pd.Timedelta(seconds=int(seconds))
        return "quoted"

    def _decide(self, c: dict) -> str:
        if c["decision"] not in ("accepted", "declined") or c["expected_revision"] is None or c["expected_revision"] < 0:
            return "invalid_decision"
        if self.status is None:
            return "not_found"
        if self.status != "quoted" or c["expected_revision"] != self.revision or not self.valid_until > c["at"]:
            return "expired_or_changed"
        self.status = c["decision"]
        return c["decision"]

    def row(self, quote_id: str, command: dict, outcome: str) -> tuple:
        return (quote_id, command["command_id"], command["at"], outcome, self.status, self.revision, self.price, self.valid_until)


def commands_of(rows: pd.DataFrame) -> Iterator[dict]:
    """Rows as commands, missing values as None."""
    for r in rows[COMMAND].astype(object).where(rows[COMMAND].notna(), None).to_dict("records"):
        yield r


def outcomes(commands: DataFrame) -> DataFrame:
    """What became of every command, and how its quote stood then: OUTCOME.

    The rows of a quote pass a task in order, one after another; nothing of them is held but the quote and the ids it has seen.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, quote = object(), Quote()
        for pdf in batches:
            out = []
            for quote_id, command in zip(pdf["quote_id"], commands_of(pdf), strict=True):
                if quote_id != now:
                    now, quote = quote_id, Quote()
                out.append(quote.row(quote_id, command, quote.apply(command)))
            yield frame(out)

    rows = commands.where(F.col("quote_id").isNotNull() & F.col("command_id").isNotNull() & F.col("at").isNotNull()).select("quote_id", *COMMAND)
    return rows.repartition("quote_id").sortWithinPartitions("quote_id", "at", "command_id").mapInPandas(run, OUTCOME)


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTCOME.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"revision": "Int32", "price": "Int32", "at": "datetime64[us]", "valid_until": "datetime64[us]"})


def view(found: DataFrame, now: str) -> DataFrame:
    """quote_id, status, revision, price, valid_until after the last command of each quote; a quote past its time is expired."""
    last = found.groupBy("quote_id").agg(F.max_by(F.struct("status", "revision", "price", "valid_until"), F.struct("at", "command_id", F.col("outcome") != "repeated")).alias("s")).select("quote_id", "s.*")
    over: Column = (F.col("status") == "quoted") & (F.col("valid_until") <= F.lit(now).cast("timestamp"))
    return last.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))
