import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ordermill import schema
from ordermill.operators import checks, partitions
from ordermill.operators.changes import update_with_stamp
from ordermill.sources.layout import read_laid_out, write_laid_out
from tests.shop import ROWS, literal, order, shop

NOW = datetime(2024, 1, 15, 12)
ORDERS = [order(f"O{i}", created=datetime(2024, 1, 1 + i % 5, i)) for i in range(20)] + [order("X", created=None), order("Y", created=None)]


@pytest.fixture
def stored(spark, tmp_path):
    def write(table, rows):
        path = str(tmp_path / table)
        df = shop(spark, **{table: rows})[table]
        write_laid_out(df, table, path)
        return path, df

    return write


def files(path):
    """Every data file with its time, by day folder."""
    return {
        folder: {name: os.stat(f"{path}/{folder}/{name}").st_mtime_ns for name in os.listdir(f"{path}/{folder}") if name.endswith(".parquet")}
        for folder in os.listdir(path) if folder.startswith("day=")
    }


def test_update_rewrites_the_touched_days_only(spark, stored, rows):
    path, df = stored("orders", ORDERS)
    before = files(path)
    updates = spark.createDataFrame([("O1", "ready"), ("O6", None), ("Y", "ready"), ("none", "ready")], "order_id string, order_status string")
    days = partitions.update_partitions(spark, "orders", path, updates, NOW)
    assert days == [None, date(2024, 1, 2)]
    after = files(path)
    assert set(after) == set(before)
    for folder in before:
        rewritten = folder in ("day=2024-01-02", "day=__HIVE_DEFAULT_PARTITION__")
        assert (after[folder] != before[folder]) == rewritten
    expected = update_with_stamp(df, updates, ["order_id"], NOW)
    assert rows(read_laid_out(spark, "orders", path).select(*df.columns)) == rows(expected)


def test_rows_move_between_days_and_empty_days_go(spark, stored, rows):
    path, df = stored("orders", ORDERS[:6])
    moves = [("O0", datetime(2024, 1, 3)), ("O5", None), ("O2", datetime(2024, 2, 1))]
    updates = spark.createDataFrame(moves, "order_id string, created_at timestamp_ntz")
    days = partitions.update_partitions(spark, "orders", path, updates, NOW)
    assert days == [None, date(2024, 1, 1), date(2024, 1, 3), date(2024, 2, 1)]
    assert set(files(path)) == {"day=__HIVE_DEFAULT_PARTITION__", "day=2024-01-02", "day=2024-01-03", "day=2024-01-04", "day=2024-01-05", "day=2024-02-01"}
    expected = update_with_stamp(df, updates, ["order_id"], NOW)
    assert rows(read_laid_out(spark, "orders", path).select(*df.columns)) == rows(expected)


def test_update_that_matches_nothing_or_twice(spark, stored):
    path, _ = stored("orders", ORDERS)
    before = files(path)
    nothing = spark.createDataFrame([("none", "ready")], "order_id string, order_status string")
    assert partitions.update_partitions(spark, "orders", path, nothing, NOW) == []
    twice = spark.createDataFrame([("O1", "ready"), ("O1", "pending")], "order_id string, order_status string")
    with pytest.raises(checks.BrokenRules):
        partitions.update_partitions(spark, "orders", path, twice, NOW)
    assert files(path) == before
    # Rows may not leave the days that were read.
    with pytest.raises(ValueError, match="were not asked for"):
        partitions.rewrite_days(
            spark, "orders", path, [date(2024, 1, 1)], lambda r: r.withColumn("created_at", F.lit("2030-01-01").cast("timestamp_ntz"))
        )
    assert files(path) == before


def test_the_update_reads_only_its_folders(spark, stored):
    path, _ = stored("orders", ORDERS)
    picked = read_laid_out(spark, "orders", path).where(partitions.in_days([date(2024, 1, 2), None]))
    folders = {os.path.basename(os.path.dirname(r[0])) for r in picked.select(F.input_file_name()).distinct().collect()}
    assert folders == {"day=2024-01-02", "day=__HIVE_DEFAULT_PARTITION__"}
    scan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in scan and "day" in scan.split("PartitionFilters: ")[1].split("]")[0]
    assert read_laid_out(spark, "orders", path).where(partitions.in_days([])).count() == 0


def test_delete_takes_the_children_of_touched_days(spark, stored, rows):
    path, orders = stored("orders", ORDERS)
    items = [
        {"order_item_id": i, "order_id": f"O{i}", "item_id": "I1", "quantity": 1, "unit_price": "1.00", "created_at": datetime(2024, 1, 1 + i % 5)}
        for i in range(20)
    ]
    item_path, _ = stored("order_items", items)
    before = files(item_path), files(path)
    gone = spark.createDataFrame([("O3",), ("O8",), ("O13",), ("O18",), ("O4",)], "order_id string")
    others = {"order_status_history": literal(spark, "order_status_history", ROWS["order_status_history"])}
    rewritten = partitions.delete_with_children(spark, {"orders": path, "order_items": item_path}, others, "orders", gone)
    assert rewritten == {name: [date(2024, 1, 4), date(2024, 1, 5)] for name in ("order_items", "orders")}
    assert {r.order_id for r in read_laid_out(spark, "orders", path).collect()} == {r["order_id"] for r in ORDERS} - {"O3", "O8", "O13", "O18", "O4"}
    assert read_laid_out(spark, "order_items", item_path).count() == 15
    for old, new in zip(before, (files(item_path), files(path))):
        assert "day=2024-01-04" not in new and all(new[f] == old[f] for f in ("day=2024-01-01", "day=2024-01-02", "day=2024-01-03"))
    blocked = spark.createDataFrame([("O2",)], "order_id string")
    with pytest.raises(checks.BrokenRules):
        partitions.delete_with_children(spark, {"orders": path, "order_items": item_path}, others, "orders", blocked)
    assert read_laid_out(spark, "order_items", item_path).count() == 15


def test_purge_drops_past_folders(spark, stored):
    sessions = [
        {"session_id": f"s{i}", "user_id": 1, "token": "t", "expires_at": t}
        for i, t in enumerate([datetime(2024, 1, 13), datetime(2024, 1, 14, 23), datetime(2024, 1, 15, 11, 59), NOW, datetime(2024, 1, 16)])
    ]
    path, _ = stored("user_sessions", sessions)
    before = files(path)
    assert partitions.purge_days(spark, "user_sessions", path, NOW) == [date(2024, 1, d) for d in (13, 14, 15)]
    assert {r.session_id for r in read_laid_out(spark, "user_sessions", path).collect()} == {"s3", "s4"}
    assert files(path)["day=2024-01-16"] == before["day=2024-01-16"]
    assert schema.TABLES["user_sessions"].key == "session_id"


def test_a_table_in_buckets_is_not_shuffled(spark, tmp_path, rows):
    from ordermill.operators.changes import absent_from_buckets, insert_if_absent
    from ordermill.sources.layout import write_buckets

    columns, path, buckets = "k long, v string, n int", str(tmp_path / "t"), 4
    target = spark.createDataFrame([(i, "old", i) for i in range(50)] + [(None, "old", 1)], columns)
    batch = spark.createDataFrame([(i, f"new{j}", j) for i in range(40, 70) for j in (2, 1)] + [(None, "new", 2)], columns)
    write_buckets(target, "bucketed", path, ["k"], buckets)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        added = absent_from_buckets(spark, "bucketed", batch, ["k"], ["n"], buckets)
        stored = added.select(*target.columns).collect()
        plan = added._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line or "Scan parquet" in line]
        assert scans and all("bucket" in line.lower() for line in scans)
        # Every exchange deals the batch; none stands above the table's scan.
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        lines = plan.split("== Initial Plan ==")[0].splitlines()
        for i, line in enumerate(lines):
            if "Exchange" in line and "hashpartitioning" in line:
                below = []
                for other in lines[i + 1 :]:
                    if depth(other) <= depth(line):
                        break
                    below.append(other)
                assert not any("bucketed" in other for other in below)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    new = spark.createDataFrame(stored, columns)
    expected = rows(insert_if_absent(target, batch, ["k"], ["n"]))
    write_buckets(new, "bucketed", path, ["k"], buckets)
    assert rows(spark.table("bucketed")) == expected
    # A second insert of the same batch adds rows without a key only.
    again = absent_from_buckets(spark, "bucketed", batch, ["k"], ["n"], buckets)
    assert [r.k for r in again.collect()] == [None]
    spark.sql("DROP TABLE bucketed")
