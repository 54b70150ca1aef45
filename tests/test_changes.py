from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ordermill.operators import changes, checks
from ordermill.plans import seeding
from ordermill.sources.layout import read_laid_out, write_laid_out
from tests.shop import ROWS, literal, shop

NOW = datetime(2024, 1, 15, 12, 0, 0)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_insert_if_absent_keeps_existing_and_first(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    incoming = spark.createDataFrame([("a", 9, 1), ("c", 5, 2), ("c", 4, 1), ("d", 7, 3)], "k string, v int, at int")
    result = changes.insert_if_absent(target, incoming, ["k"], ["at"])
    assert pairs(result, "k", "v") == [("a", 1), ("b", 2), ("c", 4), ("d", 7)]
    again = changes.insert_if_absent(result, incoming, ["k"], ["at"])
    assert pairs(again, "k", "v") == pairs(result, "k", "v")


def test_insert_if_absent_keeps_rows_without_a_key(spark):
    target = spark.createDataFrame([(None, 1)], "k string, v int")
    incoming = spark.createDataFrame([(None, 2, 1), (None, 3, 2), ("a", 4, 3)], "k string, v int, at int")
    result = changes.insert_if_absent(target, incoming, ["k"], ["at"])
    assert sorted(r.v for r in result.collect()) == [1, 2, 3, 4]


def test_other_unique_columns_are_not_forgiving(spark):
    target = spark.createDataFrame([("ada", "a@x")], "username string, email string")
    incoming = spark.createDataFrame([("bob", "a@x", 1)], "username string, email string, at int")
    with pytest.raises(checks.BrokenRules, match="email"):
        changes.insert_if_absent(target, incoming, ["username"], ["at"], other_unique=[["email"]])


def test_guards(spark):
    target = spark.createDataFrame([(1,)], "k int")
    incoming = spark.createDataFrame([(2,), (3,)], "k int")
    assert changes.insert_if_empty(target, incoming).count() == 1
    assert changes.insert_if_empty(target.where("k > 5"), incoming).count() == 2
    assert changes.insert_if_fewer(target, incoming, 1, ["k"]).count() == 1
    assert changes.insert_if_fewer(target, incoming, 2, ["k"]).count() == 3
    with pytest.raises(checks.BrokenRules):
        changes.insert_if_fewer(target, incoming.unionByName(target), 2, ["k"])


def test_defaults_apply_to_omitted_columns_only(spark):
    given = literal(spark, "orders", [{"order_id": "A", "subtotal": "1.00", "total_amount": "1.00", "tax": None}])
    row = changes.prepare(given, "orders", NOW).first()
    assert row.tax is None
    assert row.discount == Decimal("0.00")
    assert (row.order_status, row.payment_status, row.created_at) == ("pending", "pending", NOW)
    assert row.customer_id is None


def test_generated_keys_and_ids(spark):
    tables = shop(spark)
    incoming = literal(
        spark,
        "users",
        [{"username": n, "email": f"{n}@x", "password_hash": "h"} for n in ("zoe", "yan", "xi")],
    )
    users = changes.insert_rows(tables, "users", incoming, NOW, key_order=["username"])
    new = users.where(F.col("created_at") == F.lit(NOW).cast("timestamp_ntz"))
    assert pairs(new, "user_id", "username", "role") == [(3, "xi", "employee"), (4, "yan", "employee"), (5, "zoe", "employee")]
    assert new.where(F.col("public_id").rlike("^[0-9a-f-]{36}$")).count() == 3


@pytest.mark.parametrize(
    "table, row, rule",
    [
        ("users", {"username": "ada", "email": "new@x", "password_hash": "h"}, "username"),
        ("users", {"username": "new", "email": "ada@x.example", "password_hash": "h"}, "email"),
        ("users", {"username": "new", "email": "n@x", "password_hash": "h", "role": "boss"}, "role"),
        ("users", {"username": "new", "email": "n@x", "password_hash": "h", "restaurant_id": "R9"}, "restaurant_id"),
        ("users", {"username": "n" * 51, "email": "n@x", "password_hash": "h"}, "max_length"),
        ("customers", {"customer_id": "C1", "name": "n", "phone_number": "9"}, "customer_id"),
    ],
)
def test_insert_refuses_broken_rows(spark, table, row, rule):
    with pytest.raises(checks.BrokenRules, match=rule):
        changes.insert_rows(shop(spark), table, literal(spark, table, [row]), NOW)


def test_update_stamps_matched_rows(spark):
    tables = shop(spark)
    orders = tables["orders"]
    updates = spark.createDataFrame(
        [("O1", "confirmed", datetime(1999, 1, 1)), ("O7", None, None)],
        "order_id string, order_status string, updated_at timestamp_ntz",
    )
    after = {r.order_id: r for r in changes.update_table(tables, "orders", updates, NOW).collect()}
    assert len(after) == 8
    assert (after["O1"].order_status, after["O1"].updated_at) == ("confirmed", NOW)
    assert (after["O7"].order_status, after["O7"].updated_at) == (None, NOW)
    assert (after["O2"].order_status, after["O2"].updated_at) == ("delivered", None)
    same = changes.update_table(tables, "orders", orders.select("order_id").where("order_id = 'O3'"), NOW)
    assert same.where("order_id = 'O3'").first().updated_at == NOW


def test_only_some_tables_are_stamped(spark):
    tables = shop(spark)
    restaurants = tables["restaurants"]
    updates = spark.createDataFrame([("R1", "Uno")], "restaurant_id string, name string")
    after = changes.update_table(tables, "restaurants", updates, NOW)
    assert after.columns == restaurants.columns
    assert pairs(after, "restaurant_id", "name") == [("R1", "Uno"), ("R2", "Two")]


def test_two_updates_of_one_key_are_refused(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    updates = spark.createDataFrame([("a", 5), ("a", 6)], "k string, v int")
    with pytest.raises(checks.BrokenRules, match="unique k"):
        changes.update_with_stamp(target, updates, ["k"], NOW, stamp=None)


@pytest.mark.parametrize(
    "table, columns, row, rule",
    [
        ("orders", "order_id string, order_status string", ("O1", "lost"), "order_status"),
        ("orders", "order_id string, customer_id string", ("O1", "C9"), "customer_id"),
        ("customers", "customer_id string, phone_number string", ("C1", "2"), "phone_number"),
        ("customers", "customer_id string, name string", ("C1", None), "not_null name"),
    ],
)
def test_update_refuses_broken_rows(spark, table, columns, row, rule):
    tables = shop(spark)
    updates = spark.createDataFrame([row], columns)
    with pytest.raises(checks.BrokenRules, match=rule):
        changes.update_table(tables, table, updates, NOW)


def test_update_may_keep_a_unique_value(spark):
    tables = shop(spark)
    updates = spark.createDataFrame([("C1", "1"), ("C2", "3")], "customer_id string, phone_number string")
    after = changes.update_table(tables, "customers", updates, NOW)
    assert pairs(after, "customer_id", "phone_number") == [("C1", "1"), ("C2", "3")]


def test_filter_of_purge_reaches_the_scan(spark, tmp_path):
    shop(spark)["user_sessions"].write.parquet(f"{tmp_path}/user_sessions")
    kept = changes.purge_expired(spark.read.parquet(f"{tmp_path}/user_sessions"), "expires_at", NOW)
    assert "PushedFilters: [Or(" in kept._jdf.queryExecution().executedPlan().toString()


def test_purge_reads_the_days_that_are_left(spark, tmp_path):
    sessions = shop(spark)["user_sessions"]
    write_laid_out(sessions, "user_sessions", f"{tmp_path}/s")
    kept = changes.purge_expired(read_laid_out(spark, "user_sessions", f"{tmp_path}/s"), "expires_at", datetime(2024, 1, 10))
    assert [r.session_id for r in kept.collect()] == ["s1"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((day" in plan and "PushedFilters: [Or(" in plan


def test_blanks_beyond_the_length_are_cut(spark):
    incoming = literal(spark, "customers", [{"customer_id": "C3", "name": "Eve" + " " * 120, "phone_number": "3"}])
    after = changes.insert_rows(shop(spark), "customers", incoming, NOW)
    assert after.where("customer_id = 'C3'").first().name == "Eve" + " " * 97


def test_start_up_twice_changes_nothing_more(spark):
    tables = shop(spark)
    tables["menu_items"] = tables["menu_items"].limit(0)
    guards = {
        "customers": seeding.IfAbsent(
            literal(spark, "customers", [{"customer_id": "C1", "name": "other", "phone_number": "8"}, {"customer_id": "C8", "name": "new", "phone_number": "9"}]),
            "customer_id",
        ),
        "menu_items": seeding.IfEmpty(literal(spark, "menu_items", [{"item_id": "I7", "name": "Tea", "price": "2.00", "restaurant_id": "R1"}])),
        "restaurants": seeding.IfFewer(literal(spark, "restaurants", [{"restaurant_id": "R7", "name": "n", "address": "a"}]), 2),
    }
    once = seeding.start_up(tables, guards, datetime(2024, 1, 10))
    assert pairs(once["customers"], "customer_id", "name") == [("C1", "Cid"), ("C2", "Dot"), ("C8", "new")]
    assert once["menu_items"].count() == 1 and once["restaurants"].count() == 2
    assert [r.session_id for r in once["user_sessions"].collect()] == ["s1"]
    twice = seeding.start_up(once, guards, datetime(2024, 1, 10))
    for name in ("customers", "menu_items", "restaurants", "user_sessions"):
        assert sorted(map(repr, twice[name].collect())) == sorted(map(repr, once[name].collect()))


def test_purge_is_strict(spark):
    sessions = shop(spark)["user_sessions"]
    now = datetime(2024, 1, 10)
    kept = changes.purge_expired(sessions, "expires_at", now)
    assert [r.session_id for r in kept.collect()] == ["s1"]
    counts = changes.purge_counts(sessions, "expires_at", now).first()
    assert (counts.purged, counts.kept) == (1, 1)
    unknown = sessions.withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))
    assert changes.purge_expired(unknown, "expires_at", now).count() == 2


def test_delete_takes_cascading_children(spark):
    tables = shop(spark)
    changed = changes.delete_rows(tables, "orders", F.col("order_id") == "O1")
    assert set(changed) == {"orders", "order_items"}
    assert changed["orders"].count() == 7
    assert [r.order_id for r in changed["order_items"].collect()] == ["O2"]


def test_delete_is_blocked_by_history(spark):
    with pytest.raises(checks.BrokenRules, match="order_status_history"):
        changes.delete_rows(shop(spark), "orders", F.col("order_id") == "O2")


def test_delete_user(spark):
    tables = shop(spark)
    changed = changes.delete_rows(tables, "users", F.col("username") == "ben")
    assert changed["password_reset_tokens"].count() == 0
    assert [r.username for r in changed["users"].collect()] == ["ada"]
    blocked = changes.blocking_counts(tables, "users", tables["users"].where("username = 'ada'"))
    assert {r.table_name: r.violations for r in checks.failures(blocked).collect()} == {
        "login_attempts": 1,
        "user_sessions": 2,
    }


def test_delete_keeps_rows_where_the_condition_is_unknown(spark):
    tables = shop(spark, order_items=[], order_status_history=[{"history_id": 1, "new_status": "x"}])
    changed = changes.delete_rows(tables, "orders", F.col("order_status") != "pending")
    assert sorted(r.order_id for r in changed["orders"].collect()) == ["O1", "O4", "O5", "O6"]


def test_seeding_twice_changes_nothing(spark):
    from ordermill import schema

    empty = shop(spark, **{table: [] for table in ROWS})
    places = literal(spark, "restaurants", [{"restaurant_id": "R1", "name": "One", "address": "Old street"}])
    other = literal(spark, "restaurants", [{"restaurant_id": "R1", "name": "One", "address": "New street"}])
    users = literal(
        spark,
        "users",
        [{"username": u, "email": f"{u}@x", "password_hash": "h", "role": r} for u, r in (("ann", "manager"), ("sue", "user"))],
    )
    users = seeding.with_workplace(users, "R1")
    once = seeding.seed(empty, {"restaurants": seeding.IfEmpty(places), "users": seeding.IfAbsent(users, "username")}, NOW)
    twice = seeding.seed(once, {"restaurants": seeding.IfEmpty(other), "users": seeding.IfAbsent(users, "username")}, NOW)
    assert pairs(twice["restaurants"], "restaurant_id", "address") == [("R1", "Old street")]
    assert sorted((r.user_id, r.username, r.restaurant_id) for r in twice["users"].collect()) == [
        (1, "ann", "R1"),
        (2, "sue", None),
    ]
    assert set(twice) == set(schema.TABLES)


def test_seed_below_a_count_clashes_with_present_keys(spark):
    tables = shop(spark)
    more = literal(spark, "customers", [{"customer_id": "C1", "name": "X", "phone_number": "8"}])
    with pytest.raises(checks.BrokenRules, match="customer_id"):
        seeding.seed(tables, {"customers": seeding.IfFewer(more, 3)}, NOW)
    assert seeding.seed(tables, {"customers": seeding.IfFewer(more, 2)}, NOW)["customers"].count() == 2
