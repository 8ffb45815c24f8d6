"""State of keyed streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTBOX = "target_revision long, last_seq long, owner_snapshot string, status string, attempts int"


class OrderedLog(StatefulProcessor):
    """Numbers the events of a key without gaps, each event once."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")
        self.seen = handle.getMapState("seen", "event_id string", "seq long", self.forget_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(rows).drop_duplicates("event_id").sort_values(["ts", "event_id"], kind="stable")
        new = new[[not self.seen.containsKey((e,)) for e in new["event_id"]]]
        at = self.last.get()[0] if self.last.exists() else 0
        for n, event in enumerate(new["event_id"], at + 1):
            self.seen.updateValue((event,), (n,))
        if len(new):
            self.last.update((at + len(new),))
            yield pd.DataFrame({"exploration_id": key[0], "event_id": new["event_id"], "ts": new["ts"], "seq": range(at + 1, at + len(new) + 1)})

    def close(self) -> None:
        pass


class OutboxState(StatefulProcessor):
    """The outbox row of an owner; a timer sends again what stays pending."""

    def __init__(self, retry_ms: int | None):
        self.retry_ms = retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", f"{OUTBOX}, snapshot_seq long, due long")

    def told(self, key: Any, row: dict) -> pd.DataFrame:
        names = [c.split()[0] for c in OUTBOX.split(", ")]
        return pd.DataFrame([{"owner_id": key[0]} | {n: row[n] for n in names}])

    def put(self, row: dict, now: int) -> None:
        """Keeps the row; one timer at a time, when it is due."""
        if row["due"]:
            self.handle.deleteTimer(row["due"])
        row["due"] = now + self.retry_ms if self.retry_ms is not None and row["status"] == "pending" else 0
        if row["due"]:
            self.handle.registerTimer(row["due"])
        self.row.update(tuple(row[c.split()[0]] for c in f"{OUTBOX}, snapshot_seq long, due long".split(", ")))

    def held(self) -> dict:
        names = [c.split()[0] for c in f"{OUTBOX}, snapshot_seq long, due long".split(", ")]
        if self.row.exists():
            return dict(zip(names, self.row.get(), strict=True))
        return {"target_revision": 0, "last_seq": 0, "owner_snapshot": None, "status": "applied", "attempts": 0, "snapshot_seq": -1, "due": 0}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        row = self.held()
        for pdf in rows:
            for seq, snapshot, applied in zip(pdf["seq"], pdf["owner_snapshot"], pdf["applied_revision"], strict=True):
                if pd.notna(applied):
                    if int(applied) == row["target_revision"]:
                        row["status"] = "applied"
                    continue
                row["target_revision"] += 1
                row["last_seq"] = max(row["last_seq"], int(seq))
                row |= {"status": "pending", "attempts": 0}
                if pd.notna(snapshot) and int(seq) >= row["snapshot_seq"]:
                    row |= {"owner_snapshot": snapshot, "snapshot_seq": int(seq)}
        self.put(row, timerValues.getCurrentProcessingTimeInMs() if self.retry_ms is not None else 0)
        yield self.told(key, row)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        row = self.held()
        if row["status"] == "pending" and row["due"] == expiredTimerInfo.getExpiryTimeInMs():
            row |= {"attempts": row["attempts"] + 1, "due": 0}
            self.put(row, timerValues.getCurrentProcessingTimeInMs())
            yield self.told(key, row)

    def close(self) -> None:
        pass
