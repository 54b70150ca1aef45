from pyspark.sql import functions as F

from ordermill import schema
from ordermill.functions.expressions import json_value, money, unless
from ordermill.plans import views
from ordermill.sources.tables import conform, read_table, read_tables
from tests.shop import ROWS, literal, shop


def test_active_orders(spark):
    view = views.active_orders(shop(spark))
    assert view.columns == [f.name for f in schema.struct("orders").fields] + ["customer_name", "restaurant_name"]
    # NULL status, customer or restaurant drops the order; an unknown time comes first.
    assert [r.order_id for r in view.collect()] == ["O7", "O8", "O1"]
    assert {r.order_id: (r.customer_name, r.restaurant_name) for r in view.collect()} == {
        "O7": ("Dot", "Two"),
        "O8": ("Cid", "One"),
        "O1": ("Cid", "One"),
    }


def test_sort_spreads_ties_over_partitions(spark):
    df = spark.range(4000).select(F.col("id"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = views.newest_first(df, "created_at", "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4
    assert max(r["count"] for r in sizes) < 2000


def test_lookups(spark):
    users = shop(spark)["users"]
    assert views.lookup(users, "username", "ada").count() == 1
    assert [r.found for r in views.found(users, F.col("username") == "ada").collect()] == [1]
    assert views.found(users, F.col("username") == "nobody").collect() == []
    assert views.first_row(users).count() == 1
    assert views.fewer_than(users, 3) and not views.fewer_than(users, 2)


def test_unless_is_true_for_null(spark):
    df = spark.createDataFrame([("user",), ("driver",), (None,)], "role string")
    assert [r.v for r in df.select(unless(F.col("role"), "user", "R1").alias("v")).collect()] == [None, "R1", "R1"]


def test_money_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([("2.345",), ("-2.345",)], "v string").select(F.col("v").cast("decimal(10,3)").alias("v"))
    assert [str(r.m) for r in df.select(money(F.col("v")).alias("m")).collect()] == ["2.35", "-2.35"]


def test_repeated_json_key_keeps_the_last(spark):
    df = spark.createDataFrame([('{"a": 1, "a": 2}',), ("{broken",)], "j string")
    assert [r.a for r in df.select(json_value(F.col("j"), "$.a", "int").alias("a")).collect()] == [2, None]


def test_files_without_a_late_column(spark, tmp_path):
    path = str(tmp_path / "customers")
    literal(spark, "customers", ROWS["customers"]).write.parquet(path)
    customers = read_table(spark, path, "customers")
    assert customers.schema == schema.struct("customers")
    assert customers.where(F.col("user_id").isNull()).count() == 2
    assert set(read_tables(spark, str(tmp_path), ["customers"])) == {"customers"}


def test_conform_orders_and_casts(spark):
    df = spark.createDataFrame([("7", "x")], "user_id string, extra string")
    assert conform(df, schema.struct("customers")).schema == schema.struct("customers")
