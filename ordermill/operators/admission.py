"""Per-client request admission: a leaky bucket without delay.

In time order per client, with T microseconds per request and a burst of b: the
first request is admitted. Later ones raise the bucket's excess by one request,
less what leaked since; above b the request is rejected and leaves no trace.

The state is kept as one number, ``level``: the time of the last admitted request
plus its excess. A request at time t is rejected if ``level + T > t + b * T``, else
``level`` becomes ``max(t, level + T)``. All in whole microseconds, so it is exact.

The rule is sequential per client, and a client may hold a third of all requests.
So the requests are range partitioned by client and time, and a busy client spreads
over many partitions. One pass finds how each partition maps the level at its start
to the level at its end, these few maps are chained, and a second pass decides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from ordermill.functions.expressions import micros
from ordermill.operators.runs import RUN, range_runs


# Executors get this module's functions with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Limit(NamedTuple):
    micros_per_request: int
    burst: int


# 10 requests per second with burst 20, and 5 per minute with burst 3.
API_LIMIT = Limit(100_000, 20)
AUTH_LIMIT = Limit(12_000_000, 3)

# KIND numbers the limit that a request falls under; a client has one bucket per kind.
KIND, CLIENT, TIME, ID, LEVEL, ADMITTED = "_kind", "_client", "_time", "_id", "_level", "_admitted"

# Before all times: the level of a client without requests, and the time of a row
# that carries a level from an earlier batch.
NEVER = -(1 << 60)
# After all times.
UNBOUNDED = 1 << 60


def next_level(level: int, time: int, limit: Limit) -> int:
    raised = level + limit.micros_per_request
    if raised > time + limit.burst * limit.micros_per_request:
        return level
    return max(time, raised)


class LevelMap:
    """The level after some requests of one bucket, for every level before them.

    A start level is *free* as long as its bucket never ran empty. Each request raises
    it by T or rejects, so it keeps its remainder modulo T, and after n requests it is
    the largest value of that remainder up to ``min(start + n * T, ceiling)``, where
    each request at time t sets ``ceiling = min(ceiling + T, t + b * T)``. All free
    levels together thus cost two additions per request. A start level whose bucket
    ran empty at time t is *fixed*: from there on it is one level, t at first, however
    many start levels share it.

    A level never exceeds its last request's time by more than the burst; this bounds
    the start levels that need a place.
    """

    def __init__(self, first_time: int, limit: Limit):
        self.limit = limit
        self.free = [(NEVER, first_time + limit.burst * limit.micros_per_request)]
        self.raised = 0
        self.ceiling = UNBOUNDED
        self.fixed: dict[int, list[tuple[int, int]]] = {}

    def constant(self) -> int | None:
        """The one level that all start levels lead to, if it is one."""
        return next(iter(self.fixed)) if not self.free and len(self.fixed) == 1 else None

    def extend(self, times: list[int]) -> int:
        """Take in requests in order until the map is constant; gives how many."""
        step, room = self.limit.micros_per_request, self.limit.burst * self.limit.micros_per_request
        for taken, time in enumerate(times):
            if not self.free and len(self.fixed) == 1:
                return taken
            emptied = []
            if self.free:
                lowest = self.free[0][0]
                if lowest + self.raised <= time - step or self.ceiling < time:
                    emptied = self._take_emptied(time - step)
            moved: dict[int, list[tuple[int, int]]] = {}
            for level, starts in self.fixed.items():
                if level + step <= time + room:
                    level = max(time, level + step)
                moved[level] = moved[level] + starts if level in moved else starts
            if emptied:
                moved[time] = moved.get(time, []) + emptied
            self.fixed = moved
            self.ceiling = min(self.ceiling + step, time + room)
            if self.free:
                # Above the ceiling the exact height no longer matters.
                self.raised = min(self.raised + step, self.ceiling - self.free[0][0] + 1)
        return len(times)

    def _take_emptied(self, drained: int) -> list[tuple[int, int]]:
        """Remove and return the free start levels that have sunk to ``drained``.

        Below the ceiling a level is its start, raised. At the ceiling it lies
        ``(ceiling - start) % T`` under it, so the emptied ones repeat every T.
        """
        step, depth = self.limit.micros_per_request, self.ceiling - drained
        kept: list[tuple[int, int]] = []
        emptied: list[tuple[int, int]] = []

        def put(intervals: list[tuple[int, int]], low: int, high: int) -> None:
            if low <= high:
                if intervals and intervals[-1][1] == low - 1:
                    low = intervals.pop()[0]
                intervals.append((low, high))

        for low, high in self.free:
            below = min(high, self.ceiling - self.raised)
            put(emptied, low, min(below, drained - self.raised))
            put(kept, max(low, drained - self.raised + 1), below)
            low = max(low, below + 1)
            while low <= high:
                under = (self.ceiling - low) % step
                gone = under >= depth
                length = under - depth + 1 if gone else under + 1
                end = min(high, low + length - 1)
                put(emptied if gone else kept, low, end)
                low = end + 1
        self.free = kept
        return emptied

    def parts(self) -> list[tuple[int, int, int | None]]:
        """Intervals of start levels with their level; None for free ones."""
        fixed = [(low, high, level) for level, starts in self.fixed.items() for low, high in starts]
        return fixed + [(low, high, None) for low, high in self.free]


def level_after(start: int, parts: list, raised: int, ceiling: int, step: int) -> int:
    """Look a start level up in the stored parts of a map."""
    for low, high, level in parts:
        if low <= start <= high:
            if level is not None:
                return level
            return start + raised if start + raised <= ceiling else ceiling - (ceiling - start) % step
    raise ValueError(f"level {start} lies outside the map")


def _values(column: pa.Array) -> list:
    """A column without NULLs as a list; much faster than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


_PARTS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("level", pa.int64())]))
_SUMMARY_DDL = "parts array<struct<low: long, high: long, level: long>>, raised long, ceiling long"


def _summarise(limits: Sequence[Limit]):
    """Per run: its first and last bucket, and the last bucket's level at the end.

    Only rows of the last bucket matter. If it is also the first one, the level at
    the end depends on the level at the start, so a map is kept until it is constant.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = first = last = levels = None
        level = NEVER
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ending = batch.slice(batch.num_rows - 1).select([KIND, CLIENT])
            kind = ending.column(KIND)[0]
            limit = limits[kind.as_py()]
            if run is None:
                run, first, last = batch.column(RUN)[:1], batch.slice(0, 1).select([KIND, CLIENT]), ending
                if first.equals(ending):
                    levels = LevelMap(batch.column(TIME)[0].as_py(), limit)
            elif not ending.equals(last):
                levels, level = None, NEVER
            same = pc.and_(
                pc.equal(batch.column(KIND), kind), pc.equal(batch.column(CLIENT), ending.column(CLIENT)[0])
            )
            last, own = ending, batch.slice(pc.index(same, True).as_py())
            times = _values(own.column(TIME))
            if times[0] == NEVER:
                levels, level, times = None, own.column(LEVEL)[0].as_py(), times[1:]
            if levels is not None:
                times = times[levels.extend(times) :]
                if levels.constant() is not None:
                    levels, level = None, levels.constant()
            if levels is None:
                level = _walk(level, times, limit)
        if run is not None:
            parts, raised, ceiling = [(NEVER, UNBOUNDED, level)], 0, 0
            if levels is not None:
                parts, raised, ceiling = levels.parts(), levels.raised, levels.ceiling
            parts = [dict(zip(("low", "high", "level"), part)) for part in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    run,
                    *first.columns,
                    *last.columns,
                    pa.array([parts], _PARTS),
                    pa.array([raised], pa.int64()),
                    pa.array([ceiling], pa.int64()),
                ],
                names=["run", "first_kind", "first_client", "last_kind", "last_client", "parts", "raised", "ceiling"],
            )

    return summarise


def _walk(level: int, times: list[int], limit: Limit) -> int:
    step, room = limit.micros_per_request, limit.burst * limit.micros_per_request
    for time in times:
        raised = level + step
        if raised <= time + room:
            level = raised if raised > time else time
    return level


def _start_levels(summaries: list[Row], limits: Sequence[Limit]) -> dict[int, int]:
    """The level with which each run's first bucket enters the run.

    There is one short row per partition, however large the table is.
    """
    starts: dict[int, int] = {}
    bucket, level = None, NEVER
    for row in sorted(summaries, key=lambda summary: summary.run):
        entering = level if (row.first_kind, row.first_client) == bucket else NEVER
        starts[row.run] = entering
        bucket = (row.last_kind, row.last_client)
        step = limits[row.last_kind].micros_per_request
        level = level_after(entering, row.parts, row.raised, row.ceiling, step)
    return starts


def _decide(limits: Sequence[Limit], starts: dict[int, int]):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_kind = own_client = None
        step = room = 0
        level = NEVER
        for batch in batches:
            admitted, levels = [], []
            columns = (_values(batch.column(name)) for name in (KIND, CLIENT, TIME, LEVEL))
            for kind, client, time, stored in zip(*columns):
                if client != own_client or kind != own_kind:
                    level = starts[batch.column(RUN)[0].as_py()] if own_kind is None else NEVER
                    own_kind, own_client = kind, client
                    step = limits[kind].micros_per_request
                    room = limits[kind].burst * step
                if time == NEVER:
                    level = stored
                    admitted.append(None)
                else:
                    raised = level + step
                    accepted = raised <= time + room
                    if accepted:
                        level = raised if raised > time else time
                    admitted.append(accepted)
                levels.append(level)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in (KIND, CLIENT, TIME, ID)),
                    pa.array(admitted, pa.bool_()),
                    pa.array(levels, pa.int64()),
                ],
                names=[KIND, CLIENT, TIME, ID, ADMITTED, LEVEL],
            )

    return decide


def run_bucket(requests: DataFrame, limits: Sequence[Limit]) -> DataFrame:
    """Decide rows of ``_kind, _client, _time, _id, _level`` (none of the first three NULL).

    A row with time ``NEVER`` is no request: it sets the level of its bucket.
    """
    runs = range_runs(requests, [KIND, CLIENT], [TIME, ID])
    types = {field.name: field.dataType for field in runs.schema.fields}
    summary = (
        T.StructType()
        .add("run", types[RUN])
        .add("first_kind", types[KIND])
        .add("first_client", types[CLIENT])
        .add("last_kind", types[KIND])
        .add("last_client", types[CLIENT])
    )
    summary = T.StructType([*summary.fields, *T.StructType.fromDDL(_SUMMARY_DDL).fields])
    decided = (
        T.StructType()
        .add(KIND, types[KIND])
        .add(CLIENT, types[CLIENT])
        .add(TIME, "long")
        .add(ID, types[ID])
        .add(ADMITTED, "boolean")
        .add(LEVEL, "long")
    )
    needed = runs.select(RUN, KIND, CLIENT, TIME, LEVEL)
    starts = _start_levels(needed.mapInArrow(_summarise(limits), summary).collect(), limits)
    return runs.select(*needed.columns, ID).mapInArrow(_decide(limits, starts), decided)


def as_requests(df: DataFrame, client: str, time: str, id: str, kind: Column | None = None) -> DataFrame:
    return df.select(
        (F.lit(0) if kind is None else kind).cast("int").alias(KIND),
        F.col(client).alias(CLIENT),
        micros(F.col(time)).alias(TIME),
        F.col(id).alias(ID),
        F.lit(0).cast("long").alias(LEVEL),
    )


def decide_requests(requests: DataFrame, limits: Sequence[Limit]) -> DataFrame:
    """``_kind, _client, _id, _admitted`` for every request.

    A row without a client is not limited; a row without a time cannot be decided and
    gets NULL.
    """
    counted = F.col(CLIENT).isNotNull() & F.col(TIME).isNotNull()
    decided = run_bucket(requests.where(counted), limits).select(KIND, CLIENT, ID, ADMITTED)
    others = requests.where(~counted).select(
        KIND, CLIENT, ID, F.when(F.col(CLIENT).isNull(), F.lit(True)).alias(ADMITTED)
    )
    return decided.unionByName(others)


def admit(df: DataFrame, client: str, time: str, id: str, limit: Limit) -> DataFrame:
    """``client, id, admitted`` for every row of ``df`` under one limit.

    Only these columns and the time are moved; join on ``id`` for the others. ``id``
    is unique and breaks ties of time.
    """
    decided = decide_requests(as_requests(df, client, time, id), [limit])
    return decided.select(
        F.col(CLIENT).alias(client), F.col(ID).alias(id), F.col(ADMITTED).alias("admitted")
    )


def levels_after(decided: DataFrame) -> DataFrame:
    """Each bucket's level at the end of a batch. Levels never fall, so it is the
    largest one, which combines before the shuffle."""
    return decided.groupBy(KIND, CLIENT).agg(F.max(LEVEL).alias(LEVEL))


def admission_counts(decided: DataFrame, client: str) -> DataFrame:
    return decided.groupBy(client).agg(
        F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected")
    )
