import os
import random
import subprocess
import sys
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ordermill.operators import admission as bucket
from ordermill.operators.admission import API_LIMIT, AUTH_LIMIT, Limit, admit

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain_bucket(requests, limit):
    """The rule as stated: excess in microseconds, one client at a time."""
    state, result = {}, {}
    for client, time, id in sorted(requests):
        if client not in state:
            state[client], result[id] = (0, time), True
            continue
        excess, last = state[client]
        excess = max(0, excess - (time - last) + limit.micros_per_request)
        result[id] = excess <= limit.burst * limit.micros_per_request
        if result[id]:
            state[client] = (excess, time)
    return result


def decide(spark, requests, limit):
    df = spark.createDataFrame(
        [(c, START + timedelta(microseconds=t), i) for c, t, i in requests], "client string, at timestamp, id long"
    )
    return {r.id: r.admitted for r in admit(df, "client", "at", "id", limit).collect()}


times = st.lists(st.integers(0, 400), min_size=1, max_size=40).map(sorted)


@settings(max_examples=600, deadline=None)
@given(before=times, after=times, period=st.integers(1, 25), burst=st.integers(0, 5))
def test_map_equals_a_walk_from_any_level(before, after, period, burst):
    limit = Limit(period, burst)
    level = bucket.NEVER
    for time in before:
        level = bucket.next_level(level, time, limit)
    later = [before[-1] + t for t in after]
    levels = bucket.LevelMap(later[0], limit)
    taken = levels.extend(later)
    if levels.constant() is None:
        assert taken == len(later)
    highest = later[0] + burst * period
    spans = sorted((low, high) for low, high, _ in levels.parts())
    assert spans[0][0] == bucket.NEVER and spans[-1][1] == highest
    assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
    for start in {bucket.NEVER, level, *range(later[0] - 2 * period, highest + 1)}:
        end = start
        for time in later[:taken]:
            end = bucket.next_level(end, time, limit)
        assert bucket.level_after(start, levels.parts(), levels.raised, levels.ceiling, period) == end


@settings(max_examples=200, deadline=None)
@given(arrivals=times, period=st.integers(1, 25), burst=st.integers(0, 5))
def test_level_rule_equals_the_stated_rule(arrivals, period, burst):
    limit = Limit(period, burst)
    expected = plain_bucket([("c", t, i) for i, t in enumerate(arrivals)], limit)
    level, found = bucket.NEVER, {}
    for i, time in enumerate(arrivals):
        before, level = level, bucket.next_level(level, time, limit)
        found[i] = level != before
    assert found == expected


@pytest.mark.parametrize("mean", [1, 5, 20, 26, 30, 200])
def test_maps_stay_short(mean):
    limit, time, levels = Limit(26_000, 20), 0, None
    source = random.Random(mean)
    for _ in range(3000):
        time += int(source.expovariate(1 / mean) * 1000)
        levels = levels or bucket.LevelMap(time, limit)
        levels.extend([time])
        assert len(levels.parts()) <= 4 * (limit.burst + 3)


def test_api_limit_at_one_instant(spark):
    found = decide(spark, [("a", 0, i) for i in range(22)], API_LIMIT)
    assert [found[i] for i in range(22)] == [True] * 21 + [False]


def test_auth_limit(spark):
    found = decide(spark, [("a", 0, i) for i in range(5)] + [("a", 13_000_000, 5)], AUTH_LIMIT)
    assert [found[i] for i in range(6)] == [True] * 4 + [False, True]


def test_no_client_is_not_limited(spark):
    requests = [(None, 0, i) for i in range(30)] + [("a", 0, 30)]
    assert set(decide(spark, requests, API_LIMIT).values()) == {True}
    undated = spark.createDataFrame([("a", None, 1)], "client string, at timestamp, id long")
    assert [r.admitted for r in admit(undated, "client", "at", "id", API_LIMIT).collect()] == [None]


@pytest.mark.parametrize("limit", [Limit(40, 3), Limit(9, 20), Limit(2000, 2), Limit(1, 0)])
def test_busy_client_over_many_partitions(spark, many_partitions, limit):
    source = random.Random(7)
    requests, time = [], 0
    for i in range(6000):
        time += source.choice((0, 1, 5, 30))
        client = "busy" if source.random() < 0.6 else f"c{source.randrange(300)}"
        requests.append((client, time, i))
    source.shuffle(requests)
    assert decide(spark, requests, limit) == plain_bucket(requests, limit)


def test_one_client_fills_every_partition(spark, many_partitions):
    source = random.Random(3)
    time, requests = 0, []
    for i in range(5000):
        time += source.choice((0, 3, 9))
        requests.append(("only", time, i))
    df = spark.createDataFrame(
        [(c, START + timedelta(microseconds=t), i) for c, t, i in requests], "client string, at timestamp, id long"
    )
    runs = bucket.range_runs(bucket.as_requests(df, "client", "at", "id"), [bucket.KIND, bucket.CLIENT], [bucket.TIME, bucket.ID])
    assert runs.select(bucket.RUN).distinct().count() == 4
    for limit in (Limit(4, 6), Limit(5, 2), Limit(100, 1)):
        assert decide(spark, requests, limit) == plain_bucket(requests, limit)


def test_given_events_as_one_client(spark, many_partitions):
    import __spark_entry__ as contract

    path = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{path}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    expected = plain_bucket([("all", r.t, r.event_id) for r in events.collect()], contract._HOT_LIMIT)
    found = contract.queries()["admission_one_client"](spark, path).collect()
    assert {r.event_id: r.admitted for r in found} == expected


def test_levels_carry_over(spark):
    limit = Limit(10, 2)
    requests = [("a", t, t) for t in (0, 1, 2, 3, 4, 15, 16, 30)] + [("b", 5, 100)]
    expected = plain_bucket(requests, limit)
    first = spark.createDataFrame([r for r in requests if r[1] < 4], "c string, t long, i long")
    rest = spark.createDataFrame([r for r in requests if r[1] >= 4], "c string, t long, i long")
    columns = [bucket.CLIENT, bucket.TIME, bucket.ID]

    def requests_of(df):
        return df.toDF(*columns).withColumns({bucket.KIND: F.lit(0), bucket.LEVEL: F.lit(0).cast("long")})

    one = bucket.run_bucket(requests_of(first), [limit])
    levels = bucket.levels_after(one).withColumns(
        {bucket.TIME: F.lit(bucket.NEVER), bucket.ID: F.lit(None).cast("long")}
    )
    two = bucket.run_bucket(requests_of(rest).unionByName(levels), [limit])
    found = {r[bucket.ID]: r[bucket.ADMITTED] for r in one.unionByName(two).collect() if r[bucket.ID] is not None}
    assert found == expected


def test_kinds_have_buckets_of_their_own(spark, many_partitions):
    source = random.Random(9)
    limits = [Limit(20, 2), Limit(7, 5)]
    requests, time = [], 0
    for i in range(3000):
        time += source.choice((0, 1, 6))
        requests.append((source.randrange(2), "busy" if source.random() < 0.5 else f"c{source.randrange(50)}", time, i))
    expected = {}
    for kind, limit in enumerate(limits):
        expected |= plain_bucket([(c, t, i) for k, c, t, i in requests if k == kind], limit)
    df = spark.createDataFrame(
        [(k, c, START + timedelta(microseconds=t), i) for k, c, t, i in requests],
        "kind int, client string, at timestamp, id long",
    )
    decided = bucket.decide_requests(bucket.as_requests(df, "client", "at", "id", F.col("kind")), limits)
    assert {r[bucket.ID]: r[bucket.ADMITTED] for r in decided.collect()} == expected


def test_executors_need_no_installed_copy(tmp_path):
    """Python workers start in the driver's folder; here that is not the repository."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from ordermill.session import build_session
from ordermill.operators.admission import API_LIMIT, admit
spark = build_session(**{{"spark.master": "local[1]", "spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path)!r}}})
df = spark.range(30).selectExpr("id", "'a' AS client", "timestamp_seconds(0) AS at")
assert admit(df, "client", "at", "id", API_LIMIT).where("admitted").count() == 21
"""
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, timeout=300)
