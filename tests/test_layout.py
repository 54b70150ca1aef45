from pyspark.sql import functions as F

from ordermill import schema
from ordermill.sources.layout import LAYOUTS, read_laid_out, write_laid_out
from tests.shop import ROWS, shop


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_layout_keeps_the_rows(spark, tmp_path, rows):
    for table, df in shop(spark).items():
        path = str(tmp_path / table)
        write_laid_out(df, table, path)
        stored = read_laid_out(spark, table, path)
        assert stored.select(*df.columns).schema == schema.struct(table)
        assert rows(stored.select(*df.columns)) == rows(df)


def test_days_choose_folders(spark, tmp_path):
    path = str(tmp_path / "orders")
    write_laid_out(shop(spark)["orders"], "orders", path)
    orders = read_laid_out(spark, "orders", path)
    picked = orders.where(F.col("day") == F.lit("2024-01-12").cast("date"))
    assert "PartitionFilters: [isnotnull(day" in plan(picked)
    assert [r.order_id for r in picked.collect()] == ["O8"]
    assert orders.where("day IS NULL").count() == 1
    assert orders.count() == len(ROWS["orders"])


def test_key_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "users")
    write_laid_out(shop(spark)["users"], "users", path)
    found = read_laid_out(spark, "users", path).where("username = 'ada'").select("user_id")
    assert "EqualTo(username,ada)" in plan(found)
    assert "ReadSchema: struct<user_id:int,username:string>" in plan(found)
    assert [r.user_id for r in found.collect()] == [1]


def test_layouts_name_real_columns(spark):
    for table, layout in LAYOUTS.items():
        known = set(schema.struct(table).names)
        assert {*layout.clustered, *layout.looked_up} <= known
        assert layout.day_of is None or layout.day_of in known
