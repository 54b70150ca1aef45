"""What streams remember per key, in Spark's state store."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ordermill.operators.admission import NEVER, UNBOUNDED, Limit

# Executors get this module's classes with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# So many requests of a client at most are stored, or come back decided, as one row.
_PIECE = 10_000


def _pieces(pairs: list[tuple]) -> Iterator[tuple[list, list]]:
    for start in range(0, len(pairs), _PIECE):
        first, second = zip(*pairs[start : start + _PIECE])
        yield list(first), list(second)


class Admission(StatefulProcessor):
    """The leaky bucket of one client: its level, and the requests that wait for their time.

    Timers are in milliseconds and fire once the watermark is past them, so one is set to the millisecond
    before the first waiting request; all requests up to the watermark are decided then. Every call of the state
    is a message to Spark, and with many clients these are most of the work: none is made that is not needed.
    """

    def __init__(self, limit: Limit, id_type: str) -> None:
        self.limit, self.id_type = limit, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"times array<bigint>, ids array<{self.id_type}>")
        self.level = handle.getValueState("level", "level bigint, decided bigint")
        self.woken = set()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, first = self.due_before(timerValues), UNBOUNDED
        decided = None  # read if a row could be late; what was decided is older than ``now``
        late, ready = [], []
        for row in rows:
            time, id = row["time"], row["id"]
            if time < now:
                if decided is None:
                    decided = self.level.get()[1] if self.level.exists() else NEVER
                if time < decided:
                    late.append((id, None))
                    continue
            ready.append((time, id))
            first = min(first, time)
            if len(ready) == _PIECE:
                self.store(ready)
                ready = []
        if ready:
            self.store(ready)
        if first < UNBOUNDED:
            self.wake(first)
        yield from self.decisions(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if key in self.woken:
            return  # the first of a client's timers has done it all; new ones lie after the watermark
        self.woken.add(key)
        now = self.due_before(timerValues)
        stored = (request for times, ids in self.waiting.get() for request in zip(times, ids))
        # Requests of one time go by id, one without an id first.
        waiting = sorted(stored, key=lambda request: (request[0], request[1] is not None, request[1]))
        due = [request for request in waiting if request[0] < now]
        rest = waiting[len(due) :]
        step, room = self.limit.micros_per_request, self.limit.burst * self.limit.micros_per_request
        held = self.level.exists()
        level, decided = self.level.get() if held else (NEVER, NEVER)
        answers = []
        for time, id in due:
            raised = level + step
            admitted = raised <= time + room
            if admitted:
                level = max(time, raised)
            answers.append((id, admitted))
            decided = time
        if due:
            self.waiting.put(list(_pieces(rest))) if rest else self.waiting.clear()
        if rest:
            self.wake(rest[0][0])
        if level + step <= now - 1000 and not rest:
            # A drained bucket acts like none; rows so late that they would notice get no answer either way.
            if held:
                self.level.clear()
        elif due:
            self.level.update((level, decided))
            if not rest:
                self.wake(level + step + 2000)
        yield from self.decisions(key, answers)

    def due_before(self, timerValues) -> int:
        return (timerValues.getCurrentWatermarkInMs() + 1) * 1000

    def store(self, requests) -> None:
        for piece in _pieces(requests):
            self.waiting.appendValue(piece)

    def wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 - 1)

    def decisions(self, key, answers) -> Iterator[Row]:
        for ids, admitted in _pieces(answers):
            yield Row(client=key[0], ids=ids, admitted=admitted)

    def close(self) -> None:
        pass


class FirstOfKey(StatefulProcessor):
    """Lets the first row of a key through, by ``order`` within a micro-batch, and no other."""

    def __init__(self, order: tuple[str, ...], keep_hours: float | None) -> None:
        self.order, self.keep_hours = list(order), keep_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.keep_hours is None else int(self.keep_hours * 3_600_000)
        self.seen = handle.getValueState("seen", "seen boolean", ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        best = None
        for frame in rows:
            first = frame.sort_values(self.order, kind="stable").head(1)
            best = first if best is None else pd.concat([best, first]).sort_values(self.order, kind="stable").head(1)
        if best is not None:
            self.seen.update((True,))
            yield best

    def close(self) -> None:
        pass
