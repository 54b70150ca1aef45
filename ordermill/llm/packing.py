"""Best-fit packing of texts into sequences of several permitted lengths.

Item lengths are whole numbers up to the largest permitted length, so the whole packing
follows from one count per length. The driver packs these counts, longest items first:
each goes to the open bin with the least room that holds it; where there is none, new
bins open in the size that costs least per token it is expected to hold. In the end
each bin shrinks to the smallest permitted length that holds its contents. The result
is a table of ranges: the items of one length, in rank order, fill the bins of one
pattern. Items are then ranked in parallel and look up their bin.

A text longer than the largest length is cut into pieces. Null and empty texts, and others without length, get one
row with null bin. Repeated rows and rows without id are packed each for itself. Columns other than doc_id and those that
``length`` names are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ordermill.llm.stored import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITIES = (512, 1024, 2048, 4096)
# Rows of one length that are ranked in one task.
RANKED_TOGETHER = 50_000


def sequence_cost(capacity: int) -> float:
    """Cost of one sequence: linear in its length, and a quadratic part for attention."""
    return capacity * (1 + capacity / 16_384)


class Bins(NamedTuple):
    """``count`` bins of one capacity, each holding ``runs`` of (length, number of items)."""

    capacity: int
    runs: tuple[tuple[int, int], ...]
    count: int

    def filled(self) -> int:
        return sum(length * items for length, items in self.runs)


def pack_counts(
    counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost
) -> list[Bins]:
    """Pack ``counts`` items of each length; no length is above the largest capacity."""
    capacities = sorted(capacities)
    # Open bins by what fits in and their capacity: of bins with equal room the smaller goes first.
    room: dict[tuple[int, int], list[Bins]] = {}
    rooms: list[tuple[int, int]] = []
    tokens_left = sum(length * count for length, count in counts.items())

    def put(bins: Bins) -> None:
        kind = bins.capacity - bins.filled(), bins.capacity
        if kind not in room:
            room[kind] = []
            insort(rooms, kind)
        room[kind].append(bins)

    def add(bins: Bins, length: int, items: int, count: int) -> None:
        put(Bins(bins.capacity, (*bins.runs, (length, items)), count))

    def place(bins: Bins, length: int, left: int, waiting: int) -> int:
        """Fill bins of one kind with items of one length; how many items still wait."""
        each = left // length
        full = min(bins.count, waiting // each)
        if full:
            add(bins, length, each, full)
        waiting -= full * each
        spare = bins.count - full
        if spare and waiting:
            add(bins, length, waiting, 1)
            waiting, spare = 0, spare - 1
        if spare:
            put(Bins(bins.capacity, bins.runs, spare))
        return waiting

    for length in sorted(counts, reverse=True):
        waiting = counts[length]
        tokens_left -= length * waiting
        while waiting:
            at = bisect_left(rooms, (length, 0))
            if at < len(rooms):
                kind = rooms[at]
                left = kind[0]
                bins = room[kind].pop()
                if not room[kind]:
                    del room[kind]
                    rooms.pop(at)
            else:

                def price(capacity: int) -> float:
                    each = capacity // length
                    new = -(-waiting // each)
                    expected = each * length + min(capacity - each * length, tokens_left / new)
                    return cost(capacity) / expected

                left = min((c for c in capacities if c >= length), key=lambda c: (price(c), c))
                bins = Bins(left, (), -(-waiting // (left // length)))
            waiting = place(bins, length, left, waiting)
    packed = [bins for listed in room.values() for bins in listed]
    return [Bins(next(c for c in capacities if c >= b.filled()), b.runs, b.count) for b in packed]


def _ranges(packed: list[Bins]) -> dict[int, np.ndarray]:
    """Of each length: rows of (first rank, first bin, items per bin, offset in the bin, capacity)."""
    ranges: dict[int, list[tuple[int, ...]]] = {}
    ranked: dict[int, int] = {}
    first_bin = 0
    for bins in packed:
        offset = 0
        for length, items in bins.runs:
            rank = ranked.get(length, 0)
            ranges.setdefault(length, []).append((rank, first_bin, items, offset, bins.capacity))
            ranked[length] = rank + items * bins.count
            offset += length * items
        first_bin += bins.count
    return {length: np.array(rows, np.int64) for length, rows in ranges.items()}


def _assigned(ranges: dict[int, np.ndarray]):
    names = ["bin_id", "bin_capacity", "bin_offset"]

    def assign(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lengths, ranks in arrays:
            lengths, ranks = np.asarray(lengths), np.asarray(ranks)
            out = np.zeros((3, len(lengths)), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                table = ranges[int(length)]
                at = np.searchsorted(table[:, 0], ranks[rows], side="right") - 1
                first, first_bin, items, offset, capacity = table[at].T
                inside = ranks[rows] - first
                out[0, rows] = first_bin + inside // items
                out[1, rows] = capacity
                out[2, rows] = offset + inside % items * length
            yield pa.StructArray.from_arrays([pa.array(column) for column in out], names)

    return F.arrow_udf(assign, "struct<bin_id:bigint,bin_capacity:bigint,bin_offset:bigint>", F.ArrowUDFType.SCALAR_ITER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def pack(
    documents: DataFrame, length: Column | None = None, capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = sequence_cost,
) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_capacity and bin_offset of every piece of every text.

    ``length`` measures a text (by default its words between ASCII white space). ``start`` is the piece's place in its
    text and ``bin_offset`` its place in the bin, in the same unit.
    """
    most = max(capacities)
    measured = documents.select("doc_id", (word_count(F.col("text")) if length is None else length).alias("size"))
    number = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("size") / most) - 1, F.lit(0)))
    items = measured.select("doc_id", "size", F.explode(number).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * most).alias("start"),
        F.least(F.col("size") - F.col("piece") * most, F.lit(most)).cast("bigint").alias("length"),
    )
    # A number of its own spreads repeated rows; it is stored, so it stays the same whatever is run again.
    items = stored(items.withColumn("own", (F.rand() * (1 << 30)).cast("int")), "items")
    # One row per length: the largest capacity bounds them.
    sized = items.where("length > 0").groupBy("length").count().collect()
    packed = pack_counts({row.length: row["count"] for row in sized}, capacities, cost)

    groups = items.sparkSession.createDataFrame(
        [(row.length, -(-row["count"] // RANKED_TOGETHER)) for row in sized], "sized bigint, groups bigint"
    )
    spread = items.join(F.broadcast(groups), F.col("length") == F.col("sized")).withColumn(
        "slot", F.pmod(F.xxhash64("doc_id", "piece", "own"), F.col("groups"))
    )
    slots = spread.groupBy("length", "slot").count()
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(
        F.col("length").alias("_length"), F.col("slot").alias("_slot"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead")
    )
    inside = Window.partitionBy("length", "slot").orderBy("doc_id", "piece")
    ranked = spread.withColumn("inside", F.row_number().over(inside)).join(
        slots, (F.col("length") == F.col("_length")) & (F.col("slot") == F.col("_slot"))
    )
    placed = ranked.select(
        "doc_id", "piece", "start", "length",
        _assigned(_ranges(packed))("length", (F.col("ahead") + F.col("inside") - 1).cast("bigint")).alias("place"),
    ).select("doc_id", "piece", "start", "length", "place.*")
    nowhere = [F.lit(None).cast("bigint").alias(c) for c in ("bin_id", "bin_capacity", "bin_offset")]
    return placed.unionByName(items.where("length = 0").select("doc_id", "piece", "start", "length", *nowhere))
