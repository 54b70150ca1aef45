"""Ordered work over groups of any size.

A window partitioned by a key sorts each key in one task, which fails when one key
holds a large share of a table. Here the table is range partitioned by key and
order together, so one key may stretch over many partitions ("runs"), every run is
of similar size, and only one row per run crosses a run's border.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ordermill.session import cut_lineage, scratch_dir

# Executors get this module's functions with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = "_run"
POSITION = "_position"

# monotonically_increasing_id() holds the partition number above 33 bits that count
# the rows of the partition.
_ROW_BITS = 33


def range_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], backwards: bool = False) -> DataFrame:
    """``df`` sorted by keys and order over all partitions, with run number and position.

    ``order`` must end in a unique column, so that no border falls inside a tie. The
    result is stored: a second job must see the same borders.
    """
    return cut_lineage(_placed(df, [*keys, *order], backwards))


def _placed(df: DataFrame, columns: Sequence[str], backwards: bool = False) -> DataFrame:
    directed = [F.col(c).desc_nulls_last() if backwards else F.col(c).asc_nulls_first() for c in columns]
    placed = df.repartitionByRange(*directed).sortWithinPartitions(*directed)
    row_id = F.monotonically_increasing_id()
    return placed.withColumns(
        {
            RUN: F.shiftright(row_id, _ROW_BITS).cast("int"),
            POSITION: row_id.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1,
        }
    )


def previous_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], backwards: bool = False
) -> DataFrame:
    """Add, for each new name in ``values``, that column of the row before in the group.

    ``backwards`` takes the row after instead. There is one way for groups of any size:
    the table is cut into runs that are stored in order, columns are shifted by one row
    inside each run, and the first row of a run takes the last values of the run before.
    """
    runs = range_runs(df, keys, order, backwards)
    taken = list(dict.fromkeys([*keys, *values.values()]))
    # One row per run, so they fit a broadcast and an unpartitioned window.
    last = F.max_by(F.struct(*taken), POSITION)
    borders = runs.groupBy(RUN).agg(last.alias("_last")).select(
        F.col(RUN).alias("_at_run"), F.lag("_last").over(Window.orderBy(RUN)).alias("_before")
    )
    bordered = runs.join(F.broadcast(borders), F.col(RUN) == F.col("_at_run"), "left").select(
        *df.columns, POSITION, F.when(F.col(POSITION) == 1, F.col("_before")).alias("_before")
    )
    columns = T.StructType([*df.schema.fields, *(T.StructField(new, df.schema[old].dataType) for new, old in values.items())])
    return bordered.mapInArrow(_shifted(df.columns, keys, values), columns)


def _shifted(columns: list[str], keys: Sequence[str], values: dict[str, str]):
    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict[str, pa.Array] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            first = pc.equal(batch.column(POSITION), 1)
            border = batch.column("_before")

            def before(name: str) -> pa.Array:
                """The value one row earlier, whichever run or batch holds it."""
                own = batch.column(name)
                head = carried.get(name, pa.nulls(1, own.type))
                inside = pa.concat_arrays([head, own.slice(0, len(own) - 1)])
                return pc.if_else(first, pc.struct_field(border, name), inside)

            same = pa.array([True] * batch.num_rows)
            for key in keys:
                own, other = batch.column(key), before(key)
                equal = pc.fill_null(pc.equal(own, other), False)
                same = pc.and_(same, pc.or_(equal, pc.and_(pc.is_null(own), pc.is_null(other))))
            # The very first row has nothing before it: its border is null as a whole.
            same = pc.and_(same, pc.invert(pc.and_(first, pc.is_null(border))))
            shifted = [pc.if_else(same, before(old), pa.scalar(None, batch.column(old).type)) for old in values.values()]
            carried = {name: batch.column(name).slice(batch.num_rows - 1) for name in {*keys, *values.values()}}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *shifted], [*columns, *values])

    return shift


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group up to each row, groups of any size.

    Inside a run a window adds up what the run itself holds of a group. Only the group that a run
    starts with can have begun before it; what it brings along is the sum of the
    runs before, of which there is one row each.
    """
    runs = range_runs(df, keys, order)
    whole = F.struct(*(F.col(k) for k in keys))
    inside = Window.partitionBy(RUN, *keys).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    # Of each run: its first and last group, and the sum over the last one.
    groups = runs.groupBy(RUN, *keys).agg(F.sum(value).alias("_sum"), F.min(POSITION).alias("_from"))
    ends = groups.groupBy(RUN).agg(
        F.min_by(F.struct(whole.alias("group"), F.col("_sum").alias("sum")), "_from").alias("first"),
        F.max_by(F.struct(whole.alias("group"), F.col("_sum").alias("sum")), "_from").alias("last"),
        F.count(F.lit(1)).alias("groups"),
    )
    # A group that goes on through whole runs: their sums add up since the run in which it began.
    by_run = Window.orderBy(RUN)
    linked = ends.withColumns({"_before": F.lag("last").over(by_run), "_single": F.coalesce(F.lag("groups").over(by_run) == 1, F.lit(False))})
    goes_on = F.col("_before").isNotNull() & F.col("_before.group").eqNullSafe(F.col("first.group"))
    linked = linked.withColumns({"_goes_on": goes_on, "_brings": F.when(goes_on, F.col("_before.sum")).otherwise(0)})
    # A new chain starts where the group before does not go on, or began inside the run before.
    chained = linked.withColumn("_chain", F.sum((~(F.col("_goes_on") & F.col("_single"))).cast("int")).over(by_run))
    carried = F.sum("_brings").over(Window.partitionBy("_chain").orderBy(RUN))
    carry = chained.select(F.col(RUN).alias("_at_run"), F.col("first.group").alias("_first"), carried.alias("_carry"))
    joined = runs.join(F.broadcast(carry), F.col(RUN) == F.col("_at_run"))
    brought = F.when(whole.eqNullSafe(F.col("_first")), F.col("_carry")).otherwise(0)
    return joined.select(*df.columns, (F.sum(value).over(inside) + brought).alias(name))


def numbered_rows(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Number all rows ``start + 1, start + 2, ...`` in the given order.

    Rows are counted inside their run as they are stored; each run then starts after
    the rows of the runs before it. The data is shuffled once and stored by columns, so
    counting reads the run numbers only.
    """
    path = scratch_dir(df.sparkSession, "numbered")
    placed = _placed(df, order)
    placed.write.parquet(path)
    runs = df.sparkSession.read.schema(placed.schema).parquet(path)
    sizes = runs.groupBy(RUN).agg(F.count("*").alias("_rows"))
    before = Window.orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(RUN).alias("_at_run"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    # One offset per partition, so the broadcast side cannot grow with the data.
    return runs.join(F.broadcast(offsets), F.col(RUN) == F.col("_at_run")).select(
        *df.columns, (F.lit(start) + F.col("_offset") + F.col(POSITION)).alias(name)
    )
