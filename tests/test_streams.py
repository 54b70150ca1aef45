import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row, functions as F

import __spark_entry__ as contract
from ordermill.operators.admission import Limit, admit
from ordermill.operators.changes import insert_if_absent
from ordermill.plans.reports import failed_logins, latest_status
from ordermill.sources import access_logs
from ordermill.streaming import streams
from ordermill.streaming.processors import Admission
from tests.test_logs import PROXY, TORN

START = datetime(2024, 1, 1)
COLUMNS = "client string, at timestamp_ntz, id long"


def write_files(spark, folder, columns, parts):
    """One file per part, in order of arrival."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, columns).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    return (
        spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        .parquet(f"{folder}/in")
    )


def requests(count, clients, seed):
    source, time, result = random.Random(seed), 0, []
    for i in range(count):
        time += source.choice((0, 1, 4, 9))
        result.append((f"c{source.randrange(clients)}", START + timedelta(microseconds=time), i))
    return result


def run_admission(spark, folder, parts, limit, delay="0 seconds"):
    decided = streams.admission_stream(write_files(spark, folder, COLUMNS, parts), "client", "at", "id", limit, delay)
    return run(spark, decided, folder)


def run(spark, stream, folder):
    streams.append_rows(stream, f"{folder}/out", f"{folder}/progress").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def decisions(df):
    found = [(r.id, r.admitted) for r in df.collect()]
    assert len({id for id, _ in found}) == len(found)
    return dict(found)


def after(micros):
    return START + timedelta(microseconds=micros)


def test_admission_equals_batch(spark, tmp_path):
    rows, limit = requests(400, 4, 1), Limit(12, 3)
    found = run_admission(spark, str(tmp_path), [rows[:150], rows[150:151], rows[151:]], limit)
    batch = admit(spark.createDataFrame(rows, COLUMNS), "client", "at", "id", limit)
    assert decisions(found) == decisions(batch)


def test_out_of_order_requests_wait_for_the_delay_over_restarts(spark, tmp_path):
    # Limits in milliseconds, as the watermark counts them.
    limit, source, time, rows = Limit(12_000, 3), random.Random(2), 0, []
    for i in range(300):
        time += source.choice((0, 1, 4, 9)) * 1000 + source.randrange(3)
        rows.append((f"c{source.randrange(3)}", after(time), i))
    mixed = rows[:]
    for i in range(0, 290, 10):
        chunk = mixed[i : i + 10]
        random.Random(i).shuffle(chunk)
        mixed[i : i + 10] = chunk
    first = run_admission(spark, str(tmp_path), [mixed[:105], mixed[105:203]], limit, "200 milliseconds")
    some = len(decisions(first))
    assert 0 < some < 203
    # What waited is still there when the stream starts again; a row without a client moves the time on.
    last = mixed[203:] + [(None, after(time + 10_000_000), 999)]
    spark.createDataFrame(last, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/in/part=9")
    stream = spark.readStream.schema(COLUMNS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = run(spark, streams.admission_stream(stream, "client", "at", "id", limit, "200 milliseconds"), str(tmp_path))
    batch = admit(spark.createDataFrame(rows, COLUMNS), "client", "at", "id", limit)
    assert decisions(found) == {**decisions(batch), 999: True}


def test_requests_after_the_horizon_are_undecided(spark, tmp_path):
    parts = [
        [("a", after(100_000), 1), (None, after(100_000), 2), ("a", None, 5)],
        [("a", after(150_000), 4)],
        [("a", after(50_000), 3), ("a", after(200_000), 7), ("b", after(50_000), 6)],
    ]
    found = run_admission(spark, str(tmp_path), parts, Limit(100_000, 1))
    # Client b has no decided request that the late one could have changed.
    assert decisions(found) == {1: True, 2: True, 3: None, 4: True, 5: None, 6: True, 7: True}


def test_drained_levels_are_dropped(spark, tmp_path):
    parts = [[("a", after(0), 1), ("b", after(0), 2)], [("b", after(1_000_000), 3)], [("c", after(9_000_000), 4)]]
    run_admission(spark, str(tmp_path), parts, Limit(10, 3))
    state = spark.read.format("statestore").option("stateVarName", "level").load(f"{tmp_path}/progress")
    assert {r.key.client for r in state.select("key").collect()} <= {"c"}


def test_many_requests_of_one_client_equal_batch(spark, tmp_path):
    rows, limit = requests(25_000, 1, 3), Limit(5, 3)
    found = run_admission(spark, str(tmp_path), [rows], limit)
    batch = admit(spark.createDataFrame(rows, COLUMNS), "client", "at", "id", limit)
    assert decisions(found) == decisions(batch)


def test_requests_without_id_are_decided_first_of_their_time(spark, tmp_path):
    parts = [[("a", after(0), 3), ("a", after(0), None), ("a", after(0), 1), ("a", after(0), None)]]
    found = run_admission(spark, str(tmp_path), parts, Limit(100, 2))
    assert sorted((r.id is not None, r.id, r.admitted) for r in found.collect()) == [
        (False, None, True), (False, None, True), (True, 1, True), (True, 3, False),
    ]


def test_a_client_costs_few_state_calls():
    calls, waiting, level = [], [], []

    def state(held, **methods):
        return SimpleNamespace(**{name: lambda *a, f=f, name=name: (calls.append(name), f(held, *a))[1] for name, f in methods.items()})

    handle = SimpleNamespace(
        getListState=lambda *a: state(
            waiting, get=lambda held: iter(held[:]), appendValue=lambda held, value: held.append(value),
            appendList=lambda held, values: held.extend(values), exists=lambda held: bool(held), clear=lambda held: held.clear(),
        ),
        getValueState=lambda *a: state(
            level, get=lambda held: held[0], update=lambda held, value: held.__setitem__(slice(None), [value]),
            exists=lambda held: bool(held), clear=lambda held: held.clear(),
        ),
        registerTimer=lambda at: calls.append("registerTimer"),
    )
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 999)
    bucket = Admission(Limit(100_000_000, 1), "bigint")
    bucket.init(handle)
    rows = [Row(client="a", time=2_000_000 + i, id=i) for i in range(50)]
    assert list(bucket.handleInputRows(("a",), iter(rows), clock)) == []
    assert calls == ["appendValue", "registerTimer"]
    calls.clear()
    clock.getCurrentWatermarkInMs = lambda: 5_000
    answers = [list(bucket.handleExpiredTimer(("a",), clock, None)) for _ in range(2)]
    assert [[(list(row.ids), row.admitted) for row in rows] for rows in answers] == [[(list(range(50)), [True] * 2 + [False] * 48)], []]
    assert calls == ["get", "exists", "clear", "update", "registerTimer"]


@pytest.fixture(scope="module")
def wide_events(spark, tmp_path_factory):
    """Events in eight files, each of which goes over the whole time, so that every slice has many files, too."""
    folder, source = str(tmp_path_factory.mktemp("wide")), random.Random(8)
    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    kinds = ("view", "click", "error", "signup", "purchase")
    rows = [
        (i, START + timedelta(minutes=source.randrange(20 * 1440)), source.randrange(20), source.choice(kinds), source.randrange(400) / 4, "{}")
        for i in range(1600)
    ]
    for i in range(8):
        spark.createDataFrame(rows[i::8], columns).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["stream_admission", "stream_insert_if_absent", "stream_failed_logins", "stream_failure_bursts"])
def test_streams_of_many_files_equal_batch(spark, wide_events, rows, name, monkeypatch):
    folders, make = [], contract.scratch_dir
    monkeypatch.setattr(contract, "scratch_dir", lambda *a: folders.append(make(*a)) or folders[-1])
    found = contract.queries()[name](spark, wide_events)
    last = spark.read.parquet(f"{wide_events}/events.parquet").agg(F.max("ts")).first()[0]
    if name == "stream_admission":
        assert rows(found, "event_id", "admitted") == rows(contract.admission(spark, wide_events), "event_id", "admitted")
    elif name == "stream_insert_if_absent":
        earliest = spark.read.parquet(f"{wide_events}/events.parquet").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")))
        assert rows(found, "user_id", "event_id") == rows(earliest)
    elif name == "stream_failed_logins":
        whole = contract.failed_logins(spark, wide_events).select(*found.columns)
        assert rows(found) == rows(whole.where(F.col("window_end") <= F.lit(last)))
    else:
        whole = contract.failure_bursts(spark, wide_events).select(*found.columns)
        assert rows(found) == rows(whole.where(F.col("last_failure") + F.expr("INTERVAL 2 DAY") <= F.lit(last)))
    # Four slices, and after each at most one batch without rows, however many files there are.
    batches = spark.read.text(f"{folders[0]}/progress/commits").select(F.input_file_name()).distinct().count()
    assert batches <= 8


def test_insert_stream_equals_batch(spark, tmp_path, rows):
    columns = "k string, v int, at int"
    seed = spark.createDataFrame([("a", 0, 0), (None, 9, 9)], columns)
    parts = [
        [("a", 1, 1), ("b", 3, 3), ("b", 2, 2), (None, 1, 1)],
        [("b", 4, 0), ("c", 5, 5), ("c", 5, 5)],
        [("c", 6, 6), ("d", 7, 7), (None, 1, 1)],
    ]
    added = streams.first_rows(write_files(spark, str(tmp_path), columns, parts[:2]), ["k"], ["at", "v"], seed)
    run(spark, added, str(tmp_path))
    spark.createDataFrame(parts[2], columns).coalesce(1).write.parquet(f"{tmp_path}/in/part=9")
    stream = spark.readStream.schema(columns).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = run(spark, streams.first_rows(stream, ["k"], ["at", "v"], seed), str(tmp_path))
    table = seed
    for part in parts:
        table = insert_if_absent(table, spark.createDataFrame(part, columns), ["k"], ["at", "v"])
    assert rows(seed.unionByName(found)) == rows(table)


def test_repeated_and_late_rows_of_a_source(spark, tmp_path, rows):
    columns = "id long, at timestamp_ntz, v int"

    def row(id, minute, v=0):
        return (id, START + timedelta(minutes=minute), v)

    parts = [
        [row(1, 0), row(1, 0), row(2, 1)],
        [row(2, 1, 7), row(3, 30), row(1, 0, 7)],
        [row(4, 100), row(5, 99)],
        [row(8, 101)],
        [row(6, 20), row(4, 100, 7), row(7, 95)],
    ]
    found = run(spark, streams.distinct_rows(write_files(spark, str(tmp_path), columns, parts), ["id"], "at", "1 hour"), str(tmp_path))
    # The first of a key counts; row 6 comes more than an hour after the newest time.
    assert rows(found) == sorted([row(1, 0), row(2, 1), row(3, 30), row(4, 100), row(5, 99), row(7, 95), row(8, 101)], key=repr)


def test_log_stream_equals_batch(spark, tmp_path, rows):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("\n".join(PROXY[:2] + TORN[:1]) + "\n")
    (logs / "b.log").write_text("\n".join(PROXY[2:] + TORN[1:2]) + "\n")
    parsed = streams.log_stream(spark, str(logs), "10 minutes", files_per_batch=1)
    streams.ingest_log(parsed, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    stored = spark.read.schema(parsed.schema).parquet(f"{tmp_path}/out")
    batch = access_logs.read_proxy_log(spark, str(logs))
    assert rows(access_logs.requests(stored)) == rows(access_logs.requests(batch))
    assert rows(access_logs.rejects(stored)) == rows(access_logs.rejects(batch))


def test_failed_login_stream_equals_closed_windows(spark, tmp_path, rows):
    columns = "user_id int, at timestamp_ntz, failed boolean"
    source = random.Random(4)
    all_rows = [(source.randrange(3), START + timedelta(minutes=i), source.random() < 0.5) for i in range(300)]
    parts = [all_rows[:120], all_rows[120:220], all_rows[220:]]
    stream = write_files(spark, str(tmp_path), columns, parts)
    windows = streams.failed_login_stream(stream, "user_id", "at", "failed", "1 hour", "5 minutes")
    streams.append_rows(windows, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    stored = spark.read.schema(windows.schema).parquet(f"{tmp_path}/out")
    whole = failed_logins(spark.createDataFrame(all_rows, columns), "user_id", "at", "failed", "1 hour")
    horizon = START + timedelta(minutes=299 - 5)
    closed = whole.where(F.col("window_end") <= F.lit(horizon).cast("timestamp_ntz"))
    as_batch = stored.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
    assert rows(as_batch) == rows(closed)


def test_latest_status_stream_equals_batch(spark, tmp_path, rows):
    columns = "order_id string, status string, at timestamp_ntz, id int"
    source = random.Random(6)
    history = [
        (f"o{source.randrange(9)}", source.choice("abc"), START + timedelta(minutes=source.randrange(90)), i)
        for i in range(200)
    ]
    stream = write_files(spark, str(tmp_path), columns, [history[:90], history[90:95], history[95:]])
    latest = latest_status(stream, "order_id", "status", "at", "id")
    streams.store_changes(latest, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    stored = streams.current_groups(spark, f"{tmp_path}/out", ["order_id"], latest.schema)
    batch = latest_status(spark.createDataFrame(history, columns), "order_id", "status", "at", "id")
    assert rows(stored) == rows(batch)
