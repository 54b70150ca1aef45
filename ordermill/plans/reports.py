"""Reports over orders, status history, logins, sessions and items.

No definition of these is given anywhere; the ones here are our own.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ordermill.functions.expressions import at, micros
from ordermill.operators.runs import previous_values, running_sums


def latest_status(history: DataFrame, order: str, status: str, changed: str, id: str) -> DataFrame:
    """The last status per order; combines before the shuffle."""
    return history.groupBy(order).agg(
        F.max_by(status, F.struct(changed, id)).alias("latest_status"), F.max(changed).alias("since")
    )


def dwell_time(history: DataFrame, order: str, status: str, changed: str, id: str) -> DataFrame:
    """Microseconds from each change to the next one of the order; NULL for the last."""
    following = previous_values(
        history.select(order, id, status, changed), [order], [changed, id], {"until": changed}, backwards=True
    )
    return following.withColumn("micros_in_status", micros(F.col("until")) - micros(F.col(changed)))


def chain_check(history: DataFrame, order: str, old: str, new: str, changed: str, id: str) -> DataFrame:
    """Whether each change starts from the status that the change before it set."""
    linked = previous_values(
        history.select(order, id, old, new, changed), [order], [changed, id], {"previous_status": new}
    )
    return linked.withColumn("linked", F.col(old).eqNullSafe(F.col("previous_status")))


def orders_by_day(orders: DataFrame, place: str, status: str, created: str, amount: str) -> DataFrame:
    return orders.groupBy(place, status, F.to_date(created).alias("day")).agg(
        F.count("*").alias("orders"), F.sum(F.col(amount).cast("decimal(10,2)")).alias("total")
    )


def failed_logins(attempts: DataFrame, user: str, time: str, failed: str, width: str) -> DataFrame:
    """Failures per user and time window, over a batch or a watermarked stream."""
    windows = attempts.groupBy(F.window(time, width).alias("_window"), user).agg(
        F.count_if(failed).alias("failures"), F.count("*").alias("attempts")
    )
    return windows.select(
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), user, "failures", "attempts"
    )


def live_sessions(sessions: DataFrame, user: str, created: str, expires: str, moment: datetime) -> DataFrame:
    live = sessions.where((F.col(created) <= at(moment)) & (at(moment) < F.col(expires)))
    return live.groupBy(user).agg(F.count("*").alias("live_sessions"))


def item_sales(lines: DataFrame, items: DataFrame, item: str, key: str, category: str, quantity: str, price: str) -> DataFrame:
    """Units and revenue per category.

    Lines are summed per item first, so the join sees each item once, however often
    it was sold.
    """
    amount = F.col(quantity).cast("decimal(10,2)") * F.col(price).cast("decimal(10,2)")
    sold = lines.groupBy(item).agg(
        F.sum(F.col(quantity).cast("decimal(10,2)")).alias("_units"), F.sum(amount).alias("_revenue")
    )
    named = items.select(F.col(key).alias("_item_key"), category)
    return (
        sold.join(named, F.col(item) == F.col("_item_key"))
        .groupBy(category)
        .agg(F.sum("_units").alias("units"), F.sum("_revenue").alias("revenue"))
    )


def order_deltas(before: DataFrame, after: DataFrame, place: str, status: str, created: str, amount: str) -> DataFrame:
    """What changed rows do to ``orders_by_day``: the old row goes out of its group, the new one into its own.

    ``before`` and ``after`` are the changed rows alone, so this costs as much as the change is large. A
    row on one side only is an insert or a delete.
    """
    day, total = F.to_date(created).alias("day"), F.col(amount).cast("decimal(10,2)")

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        counted = F.lit(sign).cast("bigint").alias("orders"), (total * sign).alias("total"), (total.isNotNull().cast("bigint") * sign).alias("amounts")
        return rows.select(place, status, day, *counted)

    both = signed(before, -1).unionByName(signed(after, 1))
    summed = both.groupBy(place, status, "day").agg(
        F.sum("orders").alias("orders"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.sum("amounts").alias("amounts")
    )
    return summed.where((F.col("orders") != 0) | (F.col("total") != 0) | (F.col("amounts") != 0))


def merge_deltas(stored: DataFrame, deltas: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Stored partial sums with changes merged in; groups without rows go.

    Sums merge in any order and any grouping, so stored sums may be a list of deltas as well.
    """
    summed = stored.unionByName(deltas).groupBy(*groups).agg(
        F.sum("orders").alias("orders"), F.sum("total").alias("total"), F.sum("amounts").alias("amounts")
    )
    return summed.where(F.col("orders") != 0)


def report_of(stored: DataFrame) -> DataFrame:
    """The report as ``orders_by_day`` gives it: a group without amounts has no total."""
    return stored.withColumn("total", F.when(F.col("amounts") > 0, F.col("total"))).drop("amounts")


def session_peaks(sessions: DataFrame, user: str, id: str, created: str, expires: str) -> DataFrame:
    """Of each user, and of all together (NULL user): most sessions live at once, and when that was first reached.

    Each session is +1 when it starts and -1 when it ends (it is live up to, not at, its end); the running sum of these
    is the number live. It is a prefix sum over ranges of (user, time): each range sums its
    own events, and what came before it is one row per range. So neither a busy user nor the sum over all users is one task.
    A session that ends before it starts, or lacks a time, is never live; one without a user counts in the total only.
    """
    usable = sessions.where(F.col(created) < F.col(expires)).select(user, id, created, expires)
    starts = usable.select(F.col(user).alias("_user"), F.col(created).alias("_at"), F.lit(1).alias("_step"), F.col(id).alias("_id"))
    ends = usable.select(F.col(user).alias("_user"), F.col(expires).alias("_at"), F.lit(-1).alias("_step"), F.col(id).alias("_id"))
    events = starts.unionByName(ends)
    own = events.where(F.col("_user").isNotNull()).withColumn("_all", F.lit(False))
    every = events.withColumns({"_user": F.lit(None).cast(events.schema["_user"].dataType), "_all": F.lit(True)})
    # At one moment ends come before starts.
    live = running_sums(own.unionByName(every), ["_all", "_user"], ["_at", "_step", "_id"], "_step", "_live")
    best = F.min(F.struct((-F.col("_live")).alias("less"), F.col("_at").alias("at"))).alias("best")
    peaks = live.where("_step = 1").groupBy("_all", "_user").agg(best)
    return peaks.select(F.col("_user").alias(user), (-F.col("best.less")).alias("peak_sessions"), F.col("best.at").alias("peak_at"))


def failure_bursts(attempts: DataFrame, user: str, time: str, failed: str, gap: str, least: int) -> DataFrame:
    """Runs of failed logins of a user with less than ``gap`` between them, of at least ``least`` failures.

    Over a batch, or over a watermarked stream, which gives a burst once the watermark has passed its end.
    """
    # The condition names the time, so that it stays above a watermark: successes move the time on as well.
    failures = attempts.where(F.when(F.col(time).isNotNull(), F.col(failed)))
    bursts = failures.groupBy(F.session_window(time, gap).alias("_burst"), user).agg(
        F.count(F.lit(1)).alias("failures"), F.max(time).alias("last_failure")
    )
    return bursts.where(F.col("failures") >= least).select(
        user, F.col("_burst.start").alias("first_failure"), "last_failure", "failures"
    )


def dwell_sketches(dwells: DataFrame, status: str, changed: str, micros_in_status: str, k: int = 4096) -> DataFrame:
    """One quantile sketch per status and day of the change, small enough to be kept; days are merged as asked."""
    known = dwells.where(F.col(micros_in_status).isNotNull())
    return known.groupBy(status, F.to_date(changed).alias("day")).agg(
        F.kll_sketch_agg_bigint(micros_in_status, k).alias("sketch"), F.count(F.lit(1)).alias("changes")
    )


def dwell_quantiles(sketches: DataFrame, status: str, ranks: Sequence[float]) -> DataFrame:
    """Time spent in each status at the given ranks, from merged sketches.

    The true rank of each value is within 2.296 / k^0.9723 of the asked one (the public bound of KLL sketches, at 99 %): 1.33 % at
    k = 200, below 0.1 % at k = 4096. Merging keeps the bound.
    """
    merged = sketches.groupBy(status).agg(
        F.kll_merge_agg_bigint("sketch").alias("_sketch"), F.sum("changes").alias("changes")
    )
    found = F.array(
        *(F.struct(F.lit(r).alias("rank"), F.kll_sketch_get_quantile_bigint("_sketch", F.lit(r)).alias("micros_in_status")) for r in ranks)
    )
    return merged.select(status, "changes", F.inline(found))
