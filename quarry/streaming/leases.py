"""Claims with leases as state: the last note of each session holds until its lease runs out, which is told as a row."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators import queueing

CHANGE = "session_id string, id long, ts long, until long, repo_root string, state string"
_NOTE = "id long, ts long, until long, repo_root string"


class _Leases(StatefulProcessor):
    """State of a session: its last note, and a timer at the end of that note's lease."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.note = handle.getValueState("note", _NOTE)

    @staticmethod
    def _row(key, note: tuple, state: str) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "id": [note[0]], "ts": [note[1]], "until": [note[2]], "repo_root": [note[3]], "state": [state]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        have = tuple(self.note.get()) if self.note.exists() else None
        best = have
        for pdf in rows:
            last = pdf.sort_values(["ts", "id"]).iloc[-1]
            note = (int(last["id"]), int(last["ts"]), int(last["until"]), None if pd.isna(last["repo_root"]) else str(last["repo_root"]))
            if best is None or note[1::-1] > best[1::-1]:
                best = note
        if best is not have and best is not None:
            if have is not None:
                self.handle.deleteTimer(have[2])
            self.note.update(best)
            self.handle.registerTimer(best[2])
            yield self._row(key, best, "held")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.note.exists():
            note = tuple(self.note.get())
            if note[2] <= expiredTimerInfo.getExpiryTimeInMs():
                self.note.clear()
                yield self._row(key, note, "expired")

    def close(self) -> None:
        pass


def changes(notes: DataFrame, late: str = "0 seconds", default_s: int = 1800, least: int = 60, most: int = 28_800) -> DataFrame:
    """Changes of claims of a stream of notes (id, session_id, ts in ms, ttl_s, repo_root): a row `held` when a session's note takes the place of an
    earlier one, and a row `expired` once the stream's time (the largest ts so far less `late`) has passed its lease.

    After any batch, the sessions whose last change is `held` are those that queueing.live(queueing.latest_claims(notes)) gives at the stream's time. Notes
    that come later than `late` are left out, as are those without a session or time. State is one note and one timer for each session; it needs
    the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = notes.where("session_id is not null and ts is not null and id is not null").select("session_id", "id", "ts", queueing.lease_end(default_s, least, most).alias("until"), "repo_root", F.timestamp_millis("ts").alias("at"))
    timed = rows.withWatermark("at", late).groupBy("session_id")
    return timed.transformWithStateInPandas(_Leases(), CHANGE, "Append", "EventTime")
