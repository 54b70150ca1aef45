
import pytest
from pyspark.sql import functions as F

from ordermill import schema
from ordermill.operators import checks
from tests.shop import ROWS, order, shop


def broken(report):
    return {(r.table_name, r.kind, r.rule): r.violations for r in checks.failures(report).collect()}


def test_sound_tables_break_nothing(spark):
    report = checks.check_all(shop(spark))
    assert broken(report) == {}
    kinds = {r.kind: r.n for r in report.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {
        "not_null": 31,
        "allowed_values": 4,
        "not_negative": 6,
        "positive": 1,
        "max_length": 38,
        "numeric_fit": 9,
        "format": 4,
        "primary_key": 11,
        "unique": 6,
        "reference": 15,
    }


def test_each_broken_rule_is_counted(spark):
    tables = shop(
        spark,
        orders=[
            *ROWS["orders"],
            order("O9", status="lost"),
            order("O10", subtotal="-0.01"),
            order("O11", customer="C404"),
            order("O11", customer="C404"),
            order("O12", total_amount=None),
        ],
        order_items=[
            {"order_item_id": 1, "order_id": "O1", "item_id": "I1", "quantity": 0, "unit_price": "1.00", "customizations": "{broken"},
            {"order_item_id": 2, "order_id": "O1", "item_id": "I1", "quantity": 1, "unit_price": "1.00", "customizations": '{"a": 1, "a": 2}'},
        ],
        customers=[
            {"customer_id": "C1", "name": "Cid", "phone_number": "1"},
            {"customer_id": "C2", "name": "Dot", "phone_number": "1"},
            {"customer_id": "C" * 21, "name": "Eve", "phone_number": "3"},
        ],
        login_attempts=[
            {"attempt_id": 1, "user_id": 1, "ip_address": "10.0.0.256"},
            {"attempt_id": 2, "user_id": 1, "ip_address": "2001:db8::1"},
            {"attempt_id": 3, "user_id": 1, "ip_address": "10.0.0.0/8"},
        ],
    )
    assert broken(checks.check_all(tables)) == {
        ("orders", "allowed_values", "order_status"): 1,
        ("orders", "not_negative", "subtotal"): 1,
        ("orders", "reference", "customer_id -> customers.customer_id"): 2,
        ("orders", "primary_key", "order_id"): 1,
        ("orders", "not_null", "total_amount"): 1,
        ("order_items", "positive", "quantity"): 1,
        ("order_items", "format", "customizations"): 1,
        ("customers", "unique", "phone_number"): 1,
        ("customers", "max_length", "customer_id"): 1,
        ("login_attempts", "format", "ip_address"): 1,
    }


def test_numeric_fit_on_untyped_values(spark):
    df = spark.createDataFrame([("123456789.00",), ("12345678.99",), (None,), ("abc",)], "price string")
    report = checks.check_rows(df, "menu_items", [checks.fits_decimal("price", 10, 2)])
    assert [r.violations for r in report.collect()] == [2]


def test_null_passes_checks_and_uniqueness(spark):
    df = spark.createDataFrame([(None, None), (None, None), ("a", -1)], "k string, n int")
    report = checks.union_all(
        [
            checks.check_rows(df, "t", [checks.allowed("k", ("a",)), checks.not_negative("n")]),
            checks.check_unique(df, "t", ["k"]),
        ]
    )
    assert broken(report) == {("t", "not_negative", "n"): 1}


def test_broken_rows_are_named(spark):
    rules = [checks.not_null("k"), checks.positive("n")]
    df = spark.createDataFrame([(None, 0), ("a", 1), ("b", None)], "k string, n int")
    found = checks.broken_rows(df, rules).collect()
    assert [(r.k, r.broken_rules) for r in found] == [(None, ["not_null:k", "positive:n"])]


def test_require_raises_with_the_rule(spark):
    report = checks.check_unique(spark.createDataFrame([(1,), (1,)], "k int"), "t", ["k"])
    with pytest.raises(checks.BrokenRules, match="t: unique k: 1"):
        checks.require(report)


def test_counts_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") % 5 - 1).cast("int").alias("n"))
    results = []
    for parts in (1, 3, 9):
        spread = df.repartition(parts)
        report = checks.union_all(
            [checks.check_rows(spread, "t", [checks.not_negative("n")]), checks.check_unique(spread, "t", ["k"])]
        )
        results.append(broken(report))
    assert results[0] == results[1] == results[2]


def test_orphans_matched_and_null_make_up_all_rows(spark):
    child = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id") % 10).alias("fk"))
    parent = spark.range(7).select(F.col("id").alias("pk"))
    orphans = checks.orphan_rows(child, "fk", parent, "pk").count()
    counted = checks.orphan_keys(child, "fk", parent, "pk").agg(F.sum("child_rows")).first()[0]
    matched = child.join(parent, child.fk == parent.pk).count()
    assert orphans == counted
    assert orphans + matched + child.where("fk is null").count() == 900


def test_declared_sizes():
    assert len(schema.TABLES) == 11
    assert sum(len(t.references) for t in schema.TABLES.values()) == 15
    assert sum(len(t.defaults) for t in schema.TABLES.values()) == 27
    assert sum(t.serial for t in schema.TABLES.values()) == 6
    assert [n for n, t in schema.TABLES.items() if t.stamped] == ["menu_items", "users", "orders"]
