"""Reports that are kept up to date, swept over time, cut into bursts, or sketched."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ordermill.functions.expressions import variant_field
from ordermill.operators.runs import running_sums
from ordermill.plans import reports
from ordermill.sources.layout import store_variants
from ordermill.streaming import streams
from tests.test_streams import run, write_files

START = datetime(2024, 1, 1)


def after(minutes):
    return START + timedelta(minutes=minutes)


@pytest.mark.parametrize("seed", [1, 2])
def test_running_sums_over_any_number_of_runs(spark, many_partitions, seed):
    pick = random.Random(seed)
    # One group holds most rows, others are single rows, one has no name.
    rows = [(pick.choice(["hot"] * 8 + [None, f"k{pick.randrange(30)}"]), i, pick.randrange(-5, 9)) for i in range(400)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, v int")
    got = {r.at: r.total for r in running_sums(df, ["k"], ["at"], "v", "total").collect()}
    sums, expected = defaultdict(int), {}
    for k, at, v in sorted(rows, key=lambda row: row[1]):
        sums[k] += v
        expected[at] = sums[k]
    assert got == expected


def test_running_sums_of_nothing(spark):
    assert running_sums(spark.createDataFrame([], "k string, at int, v int"), ["k"], ["at"], "v", "total").collect() == []


def test_session_peaks_equal_a_sweep(spark, many_partitions):
    pick = random.Random(4)
    rows = [("hot" if pick.random() < 0.5 else f"u{pick.randrange(6)}", i, s := pick.randrange(300), s + pick.randrange(-3, 60)) for i in range(250)]
    rows += [(None, 900, 5, 50), ("u1", 901, None, 50), ("u1", 902, 5, None), ("never", 903, 9, 9)]
    df = spark.createDataFrame([(u, i, None if a is None else after(a), None if b is None else after(b)) for u, i, a, b in rows], "u string, id int, a timestamp_ntz, b timestamp_ntz")
    got = {r.u: (r.peak_sessions, r.peak_at) for r in reports.session_peaks(df, "u", "id", "a", "b").collect()}
    live = [(u, a, b) for u, _, a, b in rows if a is not None and b is not None and a < b]
    expected = {}
    for user in {u for u, _, _ in live} | {None}:
        own = live if user is None else [row for row in live if row[0] == user]
        counts = {t: sum(a <= t < b for _, a, b in own) for t in {a for _, a, _ in own}}
        most = max(counts.values())
        expected[user] = (most, after(min(t for t, n in counts.items() if n == most)))
    assert got == expected


BURSTS = [
    ("a", 0, True), ("a", 9, True), ("a", 19, True), ("a", 25, False), ("a", 40, True), ("b", 5, True), ("b", 6, False), ("b", 7, True),
    (None, 1, True), (None, 2, True), ("c", None, True), ("a", 61, True), ("a", 62, True), ("a", 63, None),
]
FOUND = [("a", 0, 19, 3), ("a", 61, 62, 2), ("b", 5, 7, 2), (None, 1, 2, 2)]


def bursts_of(rows):
    return sorted(((r.u, r.first_failure, r.last_failure, r.failures) for r in rows), key=repr)


def test_bursts_need_a_gap_between_them(spark):
    df = spark.createDataFrame([(u, None if t is None else after(t), f) for u, t, f in BURSTS], "u string, at timestamp_ntz, f boolean")
    got = bursts_of(reports.failure_bursts(df, "u", "at", "f", "10 minutes", 2).collect())
    assert got == sorted(((u, after(a), after(b), n) for u, a, b, n in FOUND), key=repr)


def test_a_batch_border_inside_a_burst(spark, tmp_path):
    rows = [(u, after(t), f) for u, t, f in BURSTS if t is not None]
    parts = [[r for r in rows if r[1] < after(8)], [r for r in rows if after(8) <= r[1] < after(45)], [r for r in rows if r[1] >= after(45)]]
    stream = write_files(spark, str(tmp_path), "u string, at timestamp_ntz, f boolean", parts)
    found = run(spark, streams.failure_burst_stream(stream, "u", "at", "f", "10 minutes", 2, "0 seconds"), str(tmp_path))
    as_batch = found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_failure", "last_failure")})
    # The burst from minute 61 on may still go on.
    assert bursts_of(as_batch.collect()) == sorted(((u, after(a), after(b), n) for u, a, b, n in FOUND if a != 61), key=repr)


COLUMNS = "place string, status string, at timestamp_ntz, amount decimal(10,2)"


def report(rows):
    groups = defaultdict(list)
    for place, status, at, amount in rows:
        groups[(place, status, at and at.date())].append(amount)
    return {key: (len(v), sum((a for a in v if a is not None), Decimal(0)) if any(a is not None for a in v) else None) for key, v in groups.items()}


def test_deltas_equal_recomputation(spark):
    pick = random.Random(7)

    def row():
        return (pick.choice("xy"), pick.choice(["new", "done", None]), pick.choice([None, datetime(2024, 1, pick.randrange(1, 4), 5)]), pick.choice([None, Decimal("1.50"), Decimal("-1.50"), Decimal("3.25")]))

    state = {i: row() for i in range(60)}
    frame = lambda rows: spark.createDataFrame(list(rows), COLUMNS)
    names = ("place", "status", "at", "amount")
    stored = reports.order_deltas(frame([]), frame(state.values()), *names)
    for batch in range(3):
        touched = pick.sample(sorted(state), 15)
        before = [state[i] for i in touched]
        for i in touched[:10]:
            state[i] = row()
        for i in touched[10:]:
            del state[i]
        new = {1000 * (batch + 1) + i: row() for i in range(4)}
        state |= new
        changed = [state[i] for i in touched[:10]] + list(new.values())
        stored = stored.unionByName(reports.order_deltas(frame(before), frame(changed), *names))
    merged = reports.merge_deltas(stored, stored.where("false"), ["place", "status", "day"])
    got = {(r.place, r.status, r.day): (r.orders, r.total) for r in reports.report_of(merged).collect()}
    assert got == report(state.values())
    # An unchanged row gives no delta; all rows gone give no group.
    same = frame(list(state.values())[:5])
    assert reports.order_deltas(same, same, *names).collect() == []
    assert reports.merge_deltas(stored, reports.order_deltas(frame(state.values()), frame([]), *names), ["place", "status", "day"]).collect() == []


@pytest.mark.parametrize("k", [200, 4096])
def test_merged_sketches_keep_their_bound(spark, k):
    pick = random.Random(11)
    rows = [("a" if i % 3 else "b", after(pick.randrange(60 * 24 * 9)), int(pick.lognormvariate(9, 2))) for i in range(30_000)] + [("a", START, None)]
    sketches = reports.dwell_sketches(spark.createDataFrame(rows, "s string, at timestamp_ntz, m long"), "s", "at", "m", k)
    assert {r.day for r in sketches.select("day").distinct().collect()} == {date(2024, 1, d) for d in range(1, 10)}
    ranks = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    bound = 2 * 2.296 / k**0.9723  # twice the bound that holds 99 times in 100
    values = {s: sorted(m for t, _, m in rows if t == s and m is not None) for s in "ab"}
    for r in reports.dwell_quantiles(sketches, "s", ranks).collect():
        own = values[r.s]
        assert r.changes == len(own)
        below, up_to = sum(v < r.micros_in_status for v in own) / len(own), sum(v <= r.micros_in_status for v in own) / len(own)
        assert below - bound <= r.rank <= up_to + bound


def test_json_is_stored_as_variant(spark, tmp_path):
    texts = ['{"a": 1, "a": 2}', '{"a": {"b": [1, "x"]}}', "{broken", None, "null", '"text"', ""]
    store_variants(spark.createDataFrame(list(enumerate(texts)), "id int, j string"), "j", f"{tmp_path}/rows", f"{tmp_path}/rejects")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert rows.schema["j"].dataType.simpleString() == "variant"
    read = rows.select("id", variant_field(F.col("j"), "$.a", "int").alias("a"), variant_field(F.col("j"), "$.a.b[1]", "string").alias("b"), F.col("j").isNull().alias("none"))
    assert {r.id: (r.a, r.b, r.none) for r in read.collect()} == {0: (2, None, False), 1: (None, "x", False), 3: (None, None, True), 4: (None, None, False), 5: (None, None, False)}
    assert Counter(r.id for r in spark.read.parquet(f"{tmp_path}/rejects").collect()) == Counter([2, 6])
