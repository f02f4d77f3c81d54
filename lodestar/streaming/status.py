"""Runs watched as their statuses arrive: what is refused is said at once, what is stuck when its time is over."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.status import NONE, RESTING, follows

#: The store of states that stateful processors need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Watcher(StatefulProcessor):
    """The state of a run: its status, the change that it comes from, when that was, and whether it was said to be stuck.

    Changes of a micro-batch are taken in order of time. A timer stands at the end of the time that a run
    may stay in its status; a change that holds takes it away and sets the next.
    """

    def __init__(self, key: str, stuck_after: timedelta) -> None:
        self.key, self.limit = key, pd.Timedelta(stuck_after)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "status string, tie long, at long, said boolean")

    def _known(self) -> tuple[str, int, pd.Timestamp | None, bool]:
        if not self.run.exists():
            return NONE, -1, None, False
        status, tie, at, said = self.run.get()
        return status, tie, pd.Timestamp(at, unit="us"), said

    def _due(self, at: pd.Timestamp) -> int:
        """Milliseconds of the first whole one behind the limit."""
        return (at + self.limit).value // 1_000_000 + 1

    def _rows(self, key: Any, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(key[0], *r) for r in found], columns=[self.key, "tie", "at", "before", "after", "kind"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        status, tie, since, said = self._known()
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "tie"]).itertuples():
            at = pd.Timestamp(r.at).tz_localize(None)
            if not follows(status, r.to):
                out.append((r.tie, at, status, r.to, "refused"))
                continue
            if since is not None and status not in RESTING and not said and since + self.limit < at:
                out.append((tie, since + self.limit, status, status, "stuck"))
            if since is not None and status not in RESTING:
                self.handle.deleteTimer(self._due(since))
            out.append((r.tie, at, status, r.to, "held"))
            status, tie, since, said = r.to, r.tie, at, False
            if status not in RESTING:
                self.handle.registerTimer(self._due(since))
        if since is not None:
            self.run.update((status, tie, since.value // 1_000, said))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, tie, since, said = self._known()
        if since is not None and status not in RESTING and not said and self._due(since) <= expiredTimerInfo.getExpiryTimeInMs():
            self.run.update((status, tie, since.value // 1_000, True))
            yield from self._rows(key, [(tie, since + self.limit, status, status, "stuck")])

    def close(self) -> None:
        pass


def watched(stream: DataFrame, key: str, status: str, at: str, tie: str, stuck_after: timedelta = timedelta(days=1), late: str = "10 minutes") -> DataFrame:
    """(key, tie, at, before, after, kind) as ``operators.status.changes`` has them, while changes arrive.

    ``at`` is a time without zone. Changes later than the watermark are left out; a run is said to be stuck when the
    watermark passes its limit.
    """
    spark = stream.sparkSession
    spark.conf.set(*STORE)
    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key), F.col(at).cast("timestamp").alias("at"), F.col(tie).cast("long").alias("tie"), F.coalesce(status, F.lit(NONE)).alias("to"))
    kind = dict(rows.dtypes)[key]
    out = f"{key} {kind}, tie long, at timestamp_ntz, before string, after string, kind string"
    return rows.withWatermark("at", late).groupBy(key).transformWithStateInPandas(Watcher(key, stuck_after), out, "Append", "EventTime")
