"""Stateful processors of the streams; their state lives in Spark's state store, one entry per key.

Events of a key come in order from one micro-batch to the next; inside a micro-batch they may come in any order. A
processor holds the columns it judges by of one key's rows of one micro-batch (the event buffer no more than the
ring), so the source's limit per trigger bounds its memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from findmill import constants as K


class EventBuffer(StatefulProcessor):
    """Numbers the events of a scan and keeps the last ``size``; the numbered events that a micro-batch leaves in the ring come out."""

    def __init__(self, columns: list[str], schema: str, order: list[str], size: int) -> None:
        self.columns, self.schema, self.size = columns, schema, size
        self.order = [columns.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")
        self.ring = handle.getListState("ring", f"seq long, {self.schema}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, newest = 0, []
        for n, row in enumerate(rows, 1):
            event = tuple(row[c] for c in self.columns)
            entry = (tuple(event[i] for i in self.order), n, event)
            if len(newest) < self.size:
                heapq.heappush(newest, entry)
            else:
                heapq.heappushpop(newest, entry)
        last = (self.last.get()[0] if self.last.exists() else 0) + n
        added = [(last - len(newest) + i, *event) for i, (_, _, event) in enumerate(sorted(newest), 1)]
        if len(added) == self.size:
            self.ring.put(added)
        else:
            held = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
            self.ring.put([*held, *added][-self.size:])
        self.last.update((last,))
        out = Row("scan_id", "seq", *self.columns)
        for event in added:
            yield out(*key, *event)


class ScanProgress(StatefulProcessor):
    """Polls whose percentage differs from the one before, up to the first 100."""

    def __init__(self, order: list[str]) -> None:
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "pct long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        pct, ended = self.progress.get() if self.progress.exists() else (-1, False)
        if ended:
            return
        out, before = Row("scan_id", *self.order, "pct"), pct
        for *place, now in sorted(tuple(row[c] for c in (*self.order, "pct")) for row in rows):
            if now != pct:
                yield out(*key, *place, now)
            pct, ended = now, now >= 100
            if ended:
                break
        if pct != before:
            self.progress.update((pct, ended))


class Triage(StatefulProcessor):
    """Audit rows of status changes; stored findings give the statuses to start from."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "status string, reason string, seq long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.current.update((initialState.status, initialState.reason, None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = tuple(self.current.get()) if self.current.exists() else ("new", None, None)
        out, now = Row("finding_id", "seq", "from_status", "to_status", "reason"), before
        for seq, status, reason in sorted(((r.seq, r.to_status, r.reason) for r in rows), key=lambda r: r[0]):
            if status != now[0]:
                yield out(*key, seq, now[0], status, reason)
                now = (status, reason, seq)
        if now != before:
            self.current.update(now)


class Lifecycle(StatefulProcessor):
    """Transitions of a scan: running at its first ``running`` event, ended at the first ``failed`` or ``aborted``, or at the
    first ``succeeded`` after it ran. An open scan has a ``status`` entry; its end clears that and leaves a mark that
    keeps late events from opening it again and goes after ``memory_ms`` of processing time.
    """

    def __init__(self, memory_ms: int) -> None:
        self.memory_ms = memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")
        self.ended = handle.getValueState("ended", "seq long", self.memory_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.ended.exists():
            return
        before = self.status.get()[0] if self.status.exists() else None
        status, out = before or "pending", Row("scan_id", "seq", "status")
        for seq, event in sorted((r.seq, r.status) for r in rows):
            if ends(status, event):
                yield out(*key, seq, event)
                yield out(*key, seq, "__end__")
                self.status.clear()
                self.ended.update((seq,))
                return
            if status == "pending" and event == "running":
                status = "running"
                yield out(*key, seq, status)
        if status != before:
            self.status.update((status,))


def ends(status: str, event: str) -> bool:
    return event in ("failed", "aborted") or (event == "succeeded" and status == "running")


class StaleScans(StatefulProcessor):
    """Fails scans of which nothing was heard for ``timeout_ms`` of event time.

    A timer per open scan fires once the watermark has passed its last event by that long. Within a micro-batch the
    gap between two events is judged the same way, so the result doesn't depend on how events fall into batches. What
    is known of an ended scan goes by a second timer ``memory_ms`` later; an event after that opens it anew.
    """

    def __init__(self, timeout_ms: int, memory_ms: int) -> None:
        self.timeout_ms, self.memory_ms = timeout_ms, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # ``due`` is when the scan's timer fires; an ended scan has no status
        self.scan = handle.getValueState("scan", "status string, due long")

    def _set(self, status: str | None, due: int, old: int | None) -> None:
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        if old != due:
            self.handle.registerTimer(due)
        self.scan.update((status, due))

    def _failed(self, key, due: int) -> Row:
        return Row("scan_id", "failed_at_ms", "status", "error")(*key, due, "failed", K.RECOVERY_MESSAGE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, due = self.scan.get() if self.scan.exists() else ("pending", None)
        if status is None:
            return
        old = due
        for at, _, event in sorted((r.at_ms, r.seq, r.status) for r in rows):
            if due is not None and at > due:
                yield self._failed(key, due)
                status = None
            elif ends(status, event):
                status, due = None, at
            if status is None:
                self._set(None, due + self.memory_ms, old)
                return
            status = "running" if event == "running" else status
            due = max(due or 0, at + self.timeout_ms)
        self._set(status, due, old)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, due = self.scan.get() if self.scan.exists() else (None, None)
        if status is None:
            self.scan.clear()
        elif due <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._failed(key, due)
            self._set(None, due + self.memory_ms, None)
