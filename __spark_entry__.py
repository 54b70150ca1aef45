"""

The given tables stand in for the ordering tables: ``orders`` and ``customer`` for
themselves, ``nation`` for restaurants, ``lineitem`` for order items, ``part`` for
menu items, ``events`` for sessions, logins, requests and status history.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ordermill import schema
from ordermill.functions.expressions import at, json_value, micros, money, not_listed, snapshot_name, unless, variant_field, well_formed
from ordermill.functions.routes import path_of
from ordermill.operators import changes, checks, partitions
from ordermill.operators.admission import Limit, admission_counts, admit
from ordermill.operators.runs import numbered_rows
from ordermill.plans import reports, request_logs, seeding, snapshots, views
from ordermill.session import scratch_dir
from ordermill.sources import access_logs, layout
from ordermill.sources.tables import conform, literal_rows
from ordermill.streaming import streams

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name, with the SQL it must equal."""

    def register(function):
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- view and lookups


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
           o_orderdate, o_orderpriority, c_name AS customer_name, n_name AS place_name
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus NOT IN ('F')
    ORDER BY o_orderdate DESC NULLS FIRST
    """
)
def active_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    opened = orders.where(not_listed(F.col("o_orderstatus"), ("F",)))
    named = views.join_columns(
        opened, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey",
        {"c_name": "customer_name", "c_nationkey": "_place"},
    )
    placed = views.join_columns(named, table(spark, sf_dir, "nation"), "_place", "n_nationkey", {"n_name": "place_name"})
    return views.newest_first(placed, "o_orderdate", "o_orderkey").select(
        "o_orderkey", "o_custkey", "o_orderstatus", money(F.col("o_totalprice")).alias("total_amount"),
        "o_orderdate", "o_orderpriority", "customer_name", "place_name",
    )


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_name = 'Customer#000000007'")
def point_lookup(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return views.lookup(customers, "c_name", "Customer#000000007")


@query("SELECT 1 AS found WHERE EXISTS (SELECT * FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'P')")
def existence_test(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return views.found(orders, (F.col("o_totalprice") > 400000) & (F.col("o_orderstatus") == "P"))


@query(
    """
    SELECT event_id, event_type,
           CASE WHEN event_type IS DISTINCT FROM 'error' THEN 'REST-001' END AS place
    FROM events
    """
)
def conditional_value(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "event_type", unless(F.col("event_type"), "error", "REST-001").alias("place"))


@query(
    """
    SELECT 'customer' AS table_name, count(*) AS row_count, count(*) < 5000 AS below_minimum FROM customer
    UNION ALL SELECT 'orders', count(*), count(*) < 5000 FROM orders
    UNION ALL SELECT 'part', count(*), count(*) < 5000 FROM part
    """
)
def count_guard(spark, sf_dir):
    tables = {name: table(spark, sf_dir, name) for name in ("customer", "orders", "part")}
    return checks.union_all(
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(views.fewer_than(df, 5000)).alias("below_minimum")
        )
        for name, df in tables.items()
    )


# ------------------------------------------------------------------ data-quality rules


def _rule_sql(*rules: tuple[str, str, str, str]) -> str:
    """One aggregate per (table, rule, kind, condition)."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{rule}' AS rule, '{kind}' AS kind, "
        f"count(*) FILTER (WHERE {violated}) AS violations FROM {name}"
        for name, rule, kind, violated in rules
    )


def _rule_report(spark, sf_dir, rules: dict[str, list[checks.Rule]]) -> DataFrame:
    return checks.union_all(checks.check_rows(table(spark, sf_dir, name), name, listed) for name, listed in rules.items())


_REQUIRED = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"),
    "lineitem": ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"),
    "events": ("event_id", "ts", "user_id", "event_type", "props"),
}


@query(_rule_sql(*((t, c, "not_null", f"{c} IS NULL") for t, columns in _REQUIRED.items() for c in columns)))
def not_null_rules(spark, sf_dir):
    return _rule_report(spark, sf_dir, {t: [checks.not_null(c) for c in columns] for t, columns in _REQUIRED.items()})


@query(
    _rule_sql(
        ("orders", "o_orderstatus", "allowed_values", "o_orderstatus NOT IN ('O', 'F')"),
        ("orders", "o_orderpriority", "allowed_values", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"),
        ("events", "event_type", "allowed_values", "event_type NOT IN ('view', 'click', 'purchase')"),
        ("customer", "c_mktsegment", "allowed_values", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    )
)
def allowed_values(spark, sf_dir):
    return _rule_report(
        spark, sf_dir,
        {
            "orders": [
                checks.allowed("o_orderstatus", ("O", "F")),
                checks.allowed("o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM")),
            ],
            "events": [checks.allowed("event_type", ("view", "click", "purchase"))],
            "customer": [checks.allowed("c_mktsegment", ("BUILDING", "MACHINERY"))],
        },
    )


@query(
    _rule_sql(
        ("customer", "c_acctbal", "not_negative", "c_acctbal < 0"),
        ("supplier", "s_acctbal", "not_negative", "s_acctbal < 0"),
        ("orders", "o_totalprice", "not_negative", "o_totalprice < 0"),
        ("lineitem", "l_extendedprice", "not_negative", "l_extendedprice < 0"),
        ("lineitem", "l_tax", "not_negative", "l_tax < 0"),
        ("lineitem", "l_quantity", "positive", "l_quantity <= 0"),
        ("lineitem", "l_discount", "positive", "l_discount <= 0"),
    )
)
def amount_rules(spark, sf_dir):
    return _rule_report(
        spark, sf_dir,
        {
            "customer": [checks.not_negative("c_acctbal")],
            "supplier": [checks.not_negative("s_acctbal")],
            "orders": [checks.not_negative("o_totalprice")],
            "lineitem": [
                checks.not_negative("l_extendedprice"),
                checks.not_negative("l_tax"),
                checks.positive("l_quantity"),
                checks.positive("l_discount"),
            ],
        },
    )


@query(
    _rule_sql(
        ("part", "p_name", "max_length", "length(p_name) > 10"),
        ("orders", "o_orderpriority", "max_length", "length(o_orderpriority) > 8"),
        ("customer", "c_name", "max_length", "length(c_name) > 18"),
        ("pages", "url", "max_length", "length(url) > 40"),
    )
)
def length_rules(spark, sf_dir):
    return _rule_report(
        spark, sf_dir,
        {
            "part": [checks.max_length("p_name", 10)],
            "orders": [checks.max_length("o_orderpriority", 8)],
            "customer": [checks.max_length("c_name", 18)],
            "pages": [checks.max_length("url", 40)],
        },
    )


@query(
    _rule_sql(
        ("orders", "o_totalprice", "numeric_fit", "TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NULL"),
        ("customer", "c_acctbal", "numeric_fit", "TRY_CAST(c_acctbal AS DECIMAL(5,2)) IS NULL"),
        ("lineitem", "l_extendedprice", "numeric_fit", "TRY_CAST(l_extendedprice AS DECIMAL(10,2)) IS NULL"),
        ("lineitem", "l_quantity", "numeric_fit", "TRY_CAST(l_quantity AS DECIMAL(3,2)) IS NULL"),
    )
)
def numeric_fit(spark, sf_dir):
    return _rule_report(
        spark, sf_dir,
        {
            "orders": [checks.fits_decimal("o_totalprice", 7, 2)],
            "customer": [checks.fits_decimal("c_acctbal", 5, 2)],
            "lineitem": [checks.fits_decimal("l_extendedprice", 10, 2), checks.fits_decimal("l_quantity", 3, 2)],
        },
    )


@query(
    _rule_sql(
        ("events", "props", "format", "NOT json_valid(props)"),
        ("events", "event_type", "format", "NOT json_valid(event_type)"),
        ("part", "p_brand", "format", "NOT regexp_full_match(p_brand, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}')"),
        ("pages", "url", "format", "NOT regexp_full_match(url, '[0-9]{1,3}([.][0-9]{1,3}){3}')"),
    )
)
def format_rules(spark, sf_dir):
    return _rule_report(
        spark, sf_dir,
        {
            "events": [checks.has_form("props", "json"), checks.has_form("event_type", "json")],
            "part": [checks.has_form("p_brand", "uuid")],
            "pages": [checks.has_form("url", "inet")],
        },
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
    WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    """
)
def duplicate_keys(spark, sf_dir):
    return checks.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _unique_sql(name: str, keys: str, kind: str) -> str:
    return f"""
    SELECT '{name}' AS table_name, '{keys}' AS rule, '{kind}' AS kind,
           CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS violations
    FROM (SELECT count(*) AS copies FROM {name} GROUP BY {keys} HAVING count(*) > 1)"""


@query(
    " UNION ALL ".join(
        (
            _unique_sql("orders", "o_orderkey", "primary_key"),
            _unique_sql("lineitem", "l_orderkey, l_linenumber", "primary_key"),
            _unique_sql("part", "p_name", "unique"),
            _unique_sql("events", "user_id", "unique"),
        )
    )
)
def unique_rules(spark, sf_dir):
    return checks.union_all(
        checks.check_unique(table(spark, sf_dir, name), name, keys, kind)
        for name, keys, kind in (
            ("orders", ["o_orderkey"], "primary_key"),
            ("lineitem", ["l_orderkey", "l_linenumber"], "primary_key"),
            ("part", ["p_name"], "unique"),
            ("events", ["user_id"], "unique"),
        )
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(10,2)) AS price
    FROM lineitem
    WHERE l_orderkey IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')
    """
)
def orphan_rows(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "F")
    orphans = checks.orphan_rows(table(spark, sf_dir, "lineitem"), "l_orderkey", parents, "o_orderkey")
    return orphans.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money(F.col("l_extendedprice")).alias("price")
    )


@query(
    """
    SELECT 'lineitem' AS table_name, 'l_orderkey -> orders.o_orderkey' AS rule, 'reference' AS kind, count(*) AS violations
    FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
    UNION ALL
    SELECT 'orders', 'o_custkey -> customer.c_custkey', 'reference', count(*)
    FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
    UNION ALL
    SELECT 'lineitem', 'l_partkey -> part.p_partkey', 'reference', count(*)
    FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    """
)
def reference_rules(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customers, parts = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    opened = orders.where(F.col("o_orderstatus") != "F")
    solvent = customers.where(F.col("c_acctbal") >= 0)
    return checks.union_all(
        [
            checks.check_reference(lines, "lineitem", "l_orderkey", opened, "orders", "o_orderkey"),
            checks.check_reference(orders, "orders", "o_custkey", solvent, "customer", "c_custkey"),
            checks.check_reference(lines, "lineitem", "l_partkey", parts, "part", "p_partkey"),
        ]
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", json_value(F.col("props"), "$.k", "int").alias("k"))


# ------------------------------------------------------------------------ row changes


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", money(F.col("o_totalprice")).alias("total_amount"), "o_orderdate", "o_orderpriority"
    )


_ORDERS_SQL = (
    "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount, "
    "o_orderdate, o_orderpriority FROM orders"
)


@query(
    f"""
    WITH target AS (SELECT * FROM ({_ORDERS_SQL}) WHERE o_orderstatus IN ('F', 'P')),
    incoming AS (
        SELECT * REPLACE (CAST(total_amount + 1 AS DECIMAL(10,2)) AS total_amount), 2 AS arrival
        FROM ({_ORDERS_SQL}) WHERE o_orderstatus IN ('O', 'P')
        UNION ALL
        SELECT * REPLACE (CAST(total_amount + 2 AS DECIMAL(10,2)) AS total_amount), 1 AS arrival
        FROM ({_ORDERS_SQL}) WHERE o_orderstatus IN ('O', 'P')
    )
    SELECT * FROM target
    UNION ALL
    SELECT * EXCLUDE (arrival, place) FROM (
        SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY arrival) AS place FROM incoming
    ) WHERE place = 1 AND o_orderkey NOT IN (SELECT o_orderkey FROM target)
    """
)
def insert_if_absent(spark, sf_dir):
    target, incoming = _inserted(spark, sf_dir)
    return changes.insert_if_absent(target, incoming, ["o_orderkey"], ["arrival"])


def _inserted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = _orders(spark, sf_dir)
    target = orders.where(F.col("o_orderstatus").isin("F", "P"))
    batch = orders.where(F.col("o_orderstatus").isin("O", "P"))

    def arriving(extra: int, arrival: int) -> DataFrame:
        raised = money(F.col("total_amount") + extra)
        return batch.withColumns({"total_amount": raised, "arrival": F.lit(arrival)})

    return target, arriving(1, 2).unionByName(arriving(2, 1))


@query(_SQL["insert_if_absent"])
def insert_into_buckets(spark, sf_dir):
    """The same insert into a table in buckets of the key; only added rows are written."""
    path, held = scratch_dir(spark, "buckets"), scratch_dir(spark, "added")
    name, keys, buckets = f"orders_{path.rsplit('-', 1)[1]}", ["o_orderkey"], 8
    target, incoming = _inserted(spark, sf_dir)
    layout.write_buckets(target, name, path, keys, buckets)
    added = changes.absent_from_buckets(spark, name, incoming, keys, ["arrival"], buckets).select(*target.columns)
    # Stored first: a table cannot grow while it is read.
    added.write.parquet(held)
    layout.write_buckets(spark.read.schema(target.schema).parquet(held), name, path, keys, buckets)
    return spark.table(name)


@query(
    """
    SELECT 'full' AS target, c_custkey, c_name FROM customer
    UNION ALL SELECT 'empty', c_custkey, upper(c_name) FROM customer
    """
)
def seed_when_empty(spark, sf_dir):
    full = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    empty = full.where(F.col("c_custkey") < 0)
    incoming = full.withColumn("c_name", F.upper("c_name"))
    parts = (("full", full), ("empty", empty))
    return checks.union_all(
        changes.insert_if_empty(target, incoming).select(F.lit(name).alias("target"), "c_custkey", "c_name")
        for name, target in parts
    )


@query(
    f"""
    SELECT 'short' AS target, * FROM ({_ORDERS_SQL})
    UNION ALL SELECT 'full', * FROM ({_ORDERS_SQL}) WHERE o_orderstatus <> 'P'
    """
)
def seed_when_fewer(spark, sf_dir):
    """One target below the minimum of three rows, one far above it."""
    orders = _orders(spark, sf_dir)
    full = orders.where(F.col("o_orderstatus") != "P")
    short = orders.where(F.col("o_orderkey") < 0)
    parts = (("short", short, orders), ("full", full, orders.where(F.col("o_orderstatus") == "P")))
    return checks.union_all(
        changes.insert_if_fewer(target, incoming, 3, ["o_orderkey"]).select(F.lit(name).alias("target"), "*")
        for name, target, incoming in parts
    )


@query(
    """
    SELECT o_orderkey, 'pending' AS status, CAST(0 AS DECIMAL(10,2)) AS tax,
           CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority,
           CAST(NULL AS VARCHAR) AS driver, TIMESTAMP '2024-01-15 00:00:00' AS created_at
    FROM orders
    """
)
def defaults_when_omitted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    given = orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"))
    return changes.with_defaults(
        given,
        {
            "o_orderkey": "long",
            "status": "string",
            "tax": "decimal(10,2)",
            "priority": "string",
            "driver": "string",
            "created_at": "timestamp_ntz",
        },
        {
            "status": F.lit("pending"),
            "tax": F.lit(0),
            "priority": F.lit("5-LOW"),
            "created_at": at(datetime(2024, 1, 15)),
        },
    )


@query(
    """
    SELECT c_custkey, c_mktsegment,
           100 + row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS generated_key
    FROM customer
    """
)
def generated_keys(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return numbered_rows(customers, ["c_mktsegment", "c_custkey"], "generated_key", start=100)


@query(
    f"""
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
           total_amount,
           CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '2024-01-15 12:30:00' ELSE o_orderdate END AS updated_at
    FROM ({_ORDERS_SQL})
    """
)
def update_with_stamp(spark, sf_dir):
    orders = _orders(spark, sf_dir).withColumnRenamed("o_orderdate", "updated_at")
    updates = orders.where(F.col("o_orderstatus") == "P").select(
        "o_orderkey", F.lit("O").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"), "updated_at"
    )
    return changes.update_with_stamp(orders, updates, ["o_orderkey"], datetime(2024, 1, 15, 12, 30))


_PURGE_TIME = datetime(2024, 1, 15)


def _sessions(spark, sf_dir) -> DataFrame:
    """Events as sessions that live for seven days."""
    lasting = F.expr("ts + INTERVAL 7 DAYS").alias("expires_at")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", lasting)


_SESSIONS_SQL = "SELECT event_id, user_id, ts, ts + INTERVAL 7 DAY AS expires_at FROM events"


@query(f"SELECT * FROM ({_SESSIONS_SQL}) WHERE expires_at >= TIMESTAMP '2024-01-15'")
def purge_expired(spark, sf_dir):
    """Sessions stored by day of expiry; the purge reads the days that are left."""
    path = scratch_dir(spark, "sessions")
    sessions = _sessions(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("session_id"), "user_id", F.lit("t").alias("token"), "expires_at",
        F.col("ts").alias("created_at"),
    )
    layout.write_laid_out(conform(sessions, schema.struct("user_sessions")), "user_sessions", path)
    kept = changes.purge_expired(layout.read_laid_out(spark, "user_sessions", path), "expires_at", _PURGE_TIME)
    return kept.select(
        F.col("session_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"),
        F.col("created_at").alias("ts"), "expires_at",
    )


@query(
    f"""
    SELECT count(*) FILTER (WHERE expires_at < TIMESTAMP '2024-01-15') AS purged,
           count(*) FILTER (WHERE expires_at >= TIMESTAMP '2024-01-15') AS kept
    FROM ({_SESSIONS_SQL})
    """
)
def purge_counts(spark, sf_dir):
    return changes.purge_counts(_sessions(spark, sf_dir), "expires_at", _PURGE_TIME)


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(10,2)) AS price
    FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    """
)
def delete_cascade(spark, sf_dir):
    deleted = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", money(F.col("l_extendedprice")).alias("price")
    )
    return changes.rows_left(lines, "l_orderkey", deleted, "o_orderkey")


@query(
    """
    SELECT 'orders' AS child, count(*) AS child_rows
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    UNION ALL
    SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    """
)
def delete_blockers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    indebted = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0)
    closed = orders.where(F.col("o_orderstatus") == "F")
    by_customer = changes.count_children(orders, "o_custkey", indebted, "c_custkey")
    by_order = changes.count_children(table(spark, sf_dir, "lineitem"), "l_orderkey", closed, "o_orderkey")
    return by_customer.select(F.lit("orders").alias("child"), "child_rows").unionByName(
        by_order.select(F.lit("lineitem").alias("child"), "child_rows")
    )


# ------------------------------------------------- declared tables, filled from the given ones

_NOW = datetime(2024, 1, 15, 12, 30)
_STATUS = {"F": "delivered", "O": "confirmed", "P": "pending"}


def _declared(spark, sf_dir) -> dict[str, DataFrame]:
    """The given tables as declared ones; columns without a counterpart are NULL."""

    def named(prefix: str, column: str) -> Column:
        return F.concat(F.lit(prefix), F.col(column))

    status = F.lit(None)
    for given, word in _STATUS.items():
        status = F.when(F.col("o_orderstatus") == given, word).otherwise(status)
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    filled = {
        "restaurants": table(spark, sf_dir, "nation").select(
            named("R", "n_nationkey").alias("restaurant_id"), F.col("n_name").alias("name"), F.col("n_name").alias("address")
        ),
        "customers": customers.select(
            named("C", "c_custkey").alias("customer_id"), F.col("c_name").alias("name"), named("+", "c_custkey").alias("phone_number")
        ),
        "orders": orders.select(
            named("O", "o_orderkey").alias("order_id"), named("C", "o_custkey").alias("customer_id"), status.alias("order_status"),
            F.col("o_totalprice").alias("subtotal"), F.col("o_totalprice").alias("total_amount"), F.col("o_orderdate").alias("created_at"),
        ),
        "order_items": table(spark, sf_dir, "lineitem").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("order_item_id"), named("O", "l_orderkey").alias("order_id"),
            F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("unit_price"),
        ),
        "order_status_history": orders.where(F.col("o_orderstatus") == "O").select(
            F.col("o_orderkey").alias("history_id"), named("O", "o_orderkey").alias("order_id"), F.lit("confirmed").alias("new_status")
        ),
        "user_sessions": _sessions(spark, sf_dir).select(
            named("S", "event_id").alias("session_id"), F.lit("t").alias("token"), "expires_at"
        ),
        "users": literal_rows(
            spark, "users",
            [{"user_id": i, "username": n, "email": f"{n}@x.example", "password_hash": "-"} for i, n in ((1, "ada"), (2, "ben"))],
        ),
    }
    return {name: conform(df, schema.struct(name)) for name, df in filled.items()}


_UPDATES_SQL = """
    SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'lost' ELSE 'ready' END AS order_status,
           o_totalprice - 100000 AS total_amount,
           CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN 'C-none'
                ELSE 'C' || CAST(o_custkey AS VARCHAR) END AS customer_id
    FROM orders WHERE o_orderstatus = 'P'
"""


@query(
    f"""
    WITH updates AS ({_UPDATES_SQL})
    SELECT * FROM (
        SELECT 'orders' AS table_name, 'order_status' AS rule, 'allowed_values' AS kind,
               count(*) FILTER (WHERE order_status = 'lost') AS violations FROM updates
        UNION ALL SELECT 'orders', 'total_amount', 'not_negative', count(*) FILTER (WHERE total_amount < 0) FROM updates
        UNION ALL SELECT 'orders', 'customer_id -> customers.customer_id', 'reference',
                         count(*) FILTER (WHERE customer_id = 'C-none') FROM updates
    ) WHERE violations > 0
    """
)
def update_checked(spark, sf_dir):
    """What an update of all pending orders would break."""
    pending = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    priority = F.col("o_orderpriority")
    updates = pending.select(
        F.concat(F.lit("O"), F.col("o_orderkey")).alias("order_id"),
        F.when(F.col("o_totalprice") > 200000, "lost").otherwise("ready").alias("order_status"),
        (F.col("o_totalprice") - 100000).alias("total_amount"),
        F.when(priority == "1-URGENT", F.lit(None)).when(priority == "2-HIGH", "C-none")
        .otherwise(F.concat(F.lit("C"), F.col("o_custkey"))).alias("customer_id"),
    )
    return checks.failures(changes.update_report(_declared(spark, sf_dir), "orders", updates, _NOW))


@query(
    """
    SELECT 'orders' AS table_name, 'O' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL
    SELECT 'order_items', CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL
    SELECT 'blocked by order_status_history', CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderstatus = 'O'
    """
)
def delete_rows(spark, sf_dir):
    """Both tables after delivered orders went, and what forbids deleting the confirmed ones."""
    tables = _declared(spark, sf_dir)
    changed = changes.delete_rows(tables, "orders", F.col("order_status") == "delivered")
    blocking = changes.blocking_counts(tables, "orders", tables["orders"].where(F.col("order_status") == "confirmed"))
    left = [
        changed[name].select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("id"))
        for name, key in (("orders", "order_id"), ("order_items", "order_item_id"))
    ]
    blocked = F.concat(F.lit("blocked by "), F.col("table_name")).alias("table_name")
    return checks.union_all([*left, blocking.select(blocked, F.col("violations").cast("string").alias("id"))])


def _by_month(spark, sf_dir) -> tuple[str, str]:
    """Orders and their items, stored in one folder per month of the order."""
    folder, tables = scratch_dir(spark, "months"), _declared(spark, sf_dir)
    month = F.date_trunc("month", F.col("created_at")).cast("timestamp_ntz")
    orders = tables["orders"].withColumn("created_at", month)
    items = tables["order_items"].drop("created_at").join(orders.select("order_id", "created_at"), "order_id")
    paths = f"{folder}/orders", f"{folder}/order_items"
    layout.write_laid_out(orders, "orders", paths[0])
    layout.write_laid_out(items.select(*tables["order_items"].columns), "order_items", paths[1])
    return paths


@query(
    """
    SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
           CASE WHEN hit THEN 'ready' WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'confirmed' ELSE 'pending' END AS order_status,
           CASE WHEN hit AND o_orderpriority = '1-URGENT' THEN TIMESTAMP '1990-01-01' ELSE CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) END AS created_at,
           CASE WHEN hit THEN TIMESTAMP '2024-01-15 12:30:00' END AS updated_at
    FROM (SELECT *, coalesce(o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1995-02-01' AND o_orderdate < TIMESTAMP '1995-08-01', false) AS hit FROM orders)
    """
)
def update_partitions(spark, sf_dir):
    """Pending orders of half a year change, the urgent ones also their month; other folders stay."""
    path, _ = _by_month(spark, sf_dir)
    first, last = (F.lit(day).cast("timestamp_ntz") for day in ("1995-02-01", "1995-08-01"))
    given, day = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    updates = given.where((F.col("o_orderstatus") == "P") & (day >= first) & (day < last)).select(
        F.concat(F.lit("O"), "o_orderkey").alias("order_id"), F.lit("ready").alias("order_status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("1990-01-01").cast("timestamp_ntz"))
        .otherwise(F.date_trunc("month", day).cast("timestamp_ntz")).alias("created_at"),
    )
    partitions.update_partitions(spark, "orders", path, updates, _NOW)
    stored = layout.read_laid_out(spark, "orders", path)
    return stored.select("order_id", "total_amount", "order_status", "created_at", "updated_at")


_GONE = "o_orderdate >= TIMESTAMP '1996-05-01' AND o_orderdate < TIMESTAMP '1996-08-01' AND o_orderpriority = '1-URGENT'"


@query(
    f"""
    SELECT 'orders' AS table_name, 'O' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE NOT ({_GONE})
    UNION ALL
    SELECT 'order_items', CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT ({_GONE})
    """
)
def delete_partitions(spark, sf_dir):
    """Urgent orders of three months go with their items; only these months are rewritten."""
    orders, items = _by_month(spark, sf_dir)
    gone = table(spark, sf_dir, "orders").where(_GONE.replace("TIMESTAMP", "TIMESTAMP_NTZ")).select(F.concat(F.lit("O"), "o_orderkey").alias("order_id"))
    others = {"order_status_history": spark.createDataFrame([], schema.struct("order_status_history"))}
    partitions.delete_with_children(spark, {"orders": orders, "order_items": items}, others, "orders", gone)
    left = [("orders", orders, "order_id"), ("order_items", items, "order_item_id")]
    return checks.union_all(
        layout.read_laid_out(spark, name, path).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("id"))
        for name, path, key in left
    )


@query(
    f"""
    SELECT 'customers' AS table_name, 'C' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer
    UNION ALL SELECT 'customers', 'C-first', 'First'
    UNION ALL SELECT 'restaurants', 'R' || CAST(n_nationkey AS VARCHAR), n_name FROM nation
    UNION ALL SELECT 'menu_items', 'I1', 'seed'
    UNION ALL SELECT 'user_sessions', 'S' || CAST(event_id AS VARCHAR), 't' FROM ({_SESSIONS_SQL})
    WHERE expires_at >= TIMESTAMP '2024-01-15'
    """
)
def start_up(spark, sf_dir):
    """Seed with each guard, then purge sessions: a new and a known customer, a table with
    enough rows, an empty table."""
    tables = _declared(spark, sf_dir)
    tables["menu_items"] = conform(tables["restaurants"].limit(0), schema.struct("menu_items"))
    guards = {
        "customers": seeding.IfAbsent(
            literal_rows(
                spark, "customers",
                [
                    {"customer_id": "C-first", "name": "First", "phone_number": "first"},
                    {"customer_id": "C1", "name": "Not this one", "phone_number": "other"},
                ],
            ),
            "customer_id",
        ),
        "restaurants": seeding.IfFewer(
            literal_rows(spark, "restaurants", [{"restaurant_id": "R-more", "name": "n", "address": "a"}]), 3
        ),
        "menu_items": seeding.IfEmpty(
            literal_rows(spark, "menu_items", [{"item_id": "I1", "name": "seed", "price": Decimal("2.00"), "restaurant_id": "R1"}])
        ),
    }
    after = seeding.start_up(tables, guards, _PURGE_TIME)
    shown = (
        ("customers", "customer_id", "name"), ("restaurants", "restaurant_id", "name"), ("menu_items", "item_id", "name"),
        ("user_sessions", "session_id", "token"),
    )
    return checks.union_all(
        after[name].select(F.lit(name).alias("table_name"), F.col(key).alias("id"), F.col(value).alias("name"))
        for name, key, value in shown
    )


def _new_users(spark, sf_dir) -> DataFrame:
    """Suppliers inserted as users: generated keys and ids, defaults, all rules checked."""
    incoming = table(spark, sf_dir, "supplier").select(
        F.concat(F.col("s_name"), F.lit(" " * 60)).alias("username"),
        F.concat(F.col("s_name"), F.lit("@x.example")).alias("email"), F.lit("-").alias("password_hash"),
    )
    return changes.insert_rows(_declared(spark, sf_dir), "users", incoming, _NOW, key_order=["username"])


@query(
    """
    SELECT 1 AS user_id, 'ada' AS username, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS TIMESTAMP) AS created_at
    UNION ALL SELECT 2, 'ben', NULL, NULL
    UNION ALL SELECT CAST(2 + row_number() OVER (ORDER BY s_name) AS INTEGER), rpad(s_name, 50, ' '), 'employee', TIMESTAMP '2024-01-15 12:30:00'
    FROM supplier
    """
)
def insert_rows(spark, sf_dir):
    return _new_users(spark, sf_dir).select("user_id", "username", "role", "created_at")


@query("SELECT count(*) AS users, count(*) AS well_formed, count(DISTINCT s_name) AS different FROM supplier")
def random_ids(spark, sf_dir):
    """New users get ids of the right form, no two alike."""
    new = _new_users(spark, sf_dir).where(F.col("public_id").isNotNull())
    return new.agg(
        F.count("*").alias("users"), F.count_if(well_formed(F.col("public_id"), "uuid")).alias("well_formed"),
        F.count_distinct("public_id").alias("different"),
    )


# --------------------------------------------------------- snapshots and versioned tables


@query(
    """
    SELECT 'events_' || strftime(taken_at, '%Y%m%d_%H%M%S') AS snapshot, taken_at,
           date_diff('day', taken_at, TIMESTAMP '2024-01-20') - 1 AS age_days,
           date_diff('day', taken_at, TIMESTAMP '2024-01-20') - 1 > 7 AS expired
    FROM (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 12 HOUR AS taken_at FROM events)
    """
)
def snapshot_retention(spark, sf_dir):
    noon = (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("taken_at")
    taken = table(spark, sf_dir, "events").select(noon).distinct()
    recorded = taken.withColumn("snapshot", snapshot_name("events", F.col("taken_at")))
    return snapshots.retention(recorded, datetime(2024, 1, 20))


@query(f"SELECT 'orders' AS table_name, * FROM ({_ORDERS_SQL})")
def snapshot_roundtrip(spark, sf_dir):
    base = scratch_dir(spark, "snapshots")
    taken = {"orders": _orders(spark, sf_dir), "customer": table(spark, sf_dir, "customer")}
    name = snapshots.take_snapshot(spark, taken, base, "shop", datetime(2024, 1, 15, 3, 0, 0))
    restored = snapshots.restore(spark, base, name, f"{base}/live")
    return restored["orders"].select(F.lit("orders").alias("table_name"), "*")


_CONTENT = {"o_orderkey": "o_orderkey", "o_orderstatus": "o_orderstatus", "total_amount": "CAST(o_totalprice AS DECIMAL(10,2))",
            "o_orderdate": "o_orderdate", "o_orderpriority": "nullif(o_orderpriority, '5-LOW')"}


def _content_sql(names: tuple[str, ...]) -> str:
    texts = [f"coalesce('=' || CAST({_CONTENT[n]} AS VARCHAR), '-')" for n in names]
    row = " || ".join(f"CAST(length({t}) AS VARCHAR) || {t}" for t in texts)
    return (
        f"SELECT '{', '.join(names)}' AS columns, count(*) AS rows, "
        f"CAST(sum(CAST('0x' || substr(md5({row}), 1, 15) AS HUGEINT)) % 1152921504606846976 AS BIGINT) AS checksum FROM orders"
    )


@query(" UNION ALL ".join(_content_sql(names) for names in [tuple(_CONTENT), *((n,) for n in _CONTENT)]))
def snapshot_checksum(spark, sf_dir):
    """Checksums of a restored table: of whole rows, and of each column."""
    base = scratch_dir(spark, "checksums")
    orders = _orders(spark, sf_dir).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    name = snapshots.take_snapshot(spark, {"orders": orders}, base, "shop", datetime(2024, 1, 15, 3, 0, 0))
    restored = snapshots.restore(spark, base, name, f"{base}/live")["orders"]
    return snapshots.content_sums(restored, [list(_CONTENT), *([n] for n in _CONTENT)])


@query(_ORDERS_SQL)
def versioned_append(spark, sf_dir):
    """New rows come in two appends, of which the second also brings later states of rows that are there."""
    path = f"{scratch_dir(spark, 'tables')}/sales"
    orders = _orders(spark, sf_dir)
    ordered = F.col("o_orderdate")
    first, second = (F.lit(day).cast("timestamp_ntz") for day in ("1997-01-01", "1999-01-01"))
    early = orders.where(ordered < first).withColumn("total_amount", money(F.col("total_amount") / 2))
    snapshots.append_rows(early, path, 1)
    for version, incoming in enumerate((orders.where(ordered < second), orders), 2):
        held = snapshots.newest_rows(spark, path, orders.schema, ["o_orderkey"])
        snapshots.append_rows(changes.absent_rows(held, incoming, ["o_orderkey"], ["o_orderdate"]), path, version)
    snapshots.append_rows(orders.where(ordered < first), path, 4)
    return snapshots.newest_rows(spark, path, orders.schema, ["o_orderkey"])


# ------------------------------------------------------------------------- request logs

_REQUEST_PATHS = {
    "view": "/api/menu",
    "signup": "/register",
    "error": "/.env",
    "click": "/static/app.css",
    "purchase": "/orders",
}

_LOG_SQL = """
    SELECT event_id, ts, value,
           '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS remote_addr,
           CASE event_type WHEN 'view' THEN '/api/menu' WHEN 'signup' THEN '/register' WHEN 'error' THEN '/.env'
                WHEN 'click' THEN '/static/app.css' ELSE '/orders' END AS path,
           CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status,
           CASE WHEN event_type <> 'signup' THEN CAST(round(value * 100) AS BIGINT) END AS body_bytes_sent,
           date_trunc('second', ts) AS time_local
    FROM events
"""


def _log_lines(spark, sf_dir, client: Column | None = None, time: Column | None = None, events: DataFrame | None = None) -> DataFrame:
    """Events as proxy log lines; those of a value below 1 are torn off."""
    events = table(spark, sf_dir, "events") if events is None else events
    kind, path = F.col("event_type"), F.lit(None)
    for event_type, prefix in _REQUEST_PATHS.items():
        path = F.when(kind == event_type, F.lit(prefix)).otherwise(path)
    fields: dict[str, Column] = {
        "remote_addr": F.concat(F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), F.expr("user_id % 256")) if client is None else client,
        "remote_user": F.lit(None),
        "time_local": F.col("ts") if time is None else time,
        "request": F.concat(F.lit("GET "), path, F.lit("?id="), F.col("event_id"), F.lit(" HTTP/1.1")),
        "status": F.when(kind == "error", 404).otherwise(200),
        "body_bytes_sent": F.when(kind != "signup", F.round(F.col("value") * 100).cast("long")),
        "referer": F.lit(None),
        "user_agent": F.lit("shop/1.0 (test)"),
        "x_forwarded_for": F.lit(None),
    }
    torn = F.col("value") < 1
    keep = events.withColumn("_torn", torn)
    lines = access_logs.render_proxy_lines(keep, fields, "_torn")
    return lines.select(F.when(F.col("_torn"), F.substr("value", F.lit(1), F.lit(40))).otherwise(F.col("value")).alias("value"))


def _parsed_requests(parsed: DataFrame) -> DataFrame:
    return access_logs.requests(parsed).select(
        F.regexp_extract("target", "id=(\\d+)", 1).cast("long").alias("event_id"),
        "remote_addr",
        F.col("time_local").cast("timestamp_ntz").alias("time_local"),
        "method",
        "target",
        "path",
        "protocol",
        "status",
        "body_bytes_sent",
        "user_agent",
        "remote_user",
    )


_PARSED_SQL = f"""
    SELECT event_id, remote_addr, time_local, 'GET' AS method, path || '?id=' || CAST(event_id AS VARCHAR) AS target, path,
           'HTTP/1.1' AS protocol, CAST(status AS INTEGER) AS status, body_bytes_sent,
           'shop/1.0 (test)' AS user_agent, CAST(NULL AS VARCHAR) AS remote_user
    FROM ({_LOG_SQL}) WHERE value >= 1
"""


@query(_PARSED_SQL)
def parse_access_log(spark, sf_dir):
    return _parsed_requests(access_logs.parse_proxy_lines(_log_lines(spark, sf_dir)))


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE value < 1) AS rejected FROM events")
def log_rejects(spark, sf_dir):
    parsed = access_logs.parse_proxy_lines(_log_lines(spark, sf_dir))
    return parsed.agg(F.count("*").alias("lines"), F.count_if(~F.col("understood")).alias("rejected"))


@query(
    """
    SELECT event_id, 'say "' || event_type || '"' AS user_agent, date_trunc('second', ts) AS time_local,
           CASE WHEN event_type <> 'signup' THEN CAST(round(value * 100) AS BIGINT) END AS body_bytes_sent
    FROM events
    """
)
def parse_app_log(spark, sf_dir):
    """The application server escapes quotes and may write a dash for the size."""
    events = table(spark, sf_dir, "events")
    size = F.when(F.col("event_type") != "signup", F.round(F.col("value") * 100).cast("long"))
    line = F.concat(
        F.lit("10.0.0.2 - - ["), F.date_format("ts", access_logs.TIME_FORMAT), F.lit('] "POST /orders/'),
        F.col("event_id"), F.lit(' HTTP/1.1" 201 '), F.coalesce(size.cast("string"), F.lit("-")),
        F.lit(' "-" "say \\"'), F.col("event_type"), F.lit('\\""'),
    )
    parsed = access_logs.requests(access_logs.parse_app_lines(events.select(line.alias("value"))))
    return parsed.select(
        F.regexp_extract("target", "(\\d+)$", 1).cast("long").alias("event_id"),
        F.replace("user_agent", F.lit('\\"'), F.lit('"')).alias("user_agent"),
        F.col("time_local").cast("timestamp_ntz").alias("time_local"),
        "body_bytes_sent",
    )


_ROUTE_SQL = """
    CASE WHEN path LIKE '/login%' OR path LIKE '/register%' OR path LIKE '/reset-password%' THEN 'auth'
         WHEN contains(path, '/.') THEN 'denied'
         WHEN path LIKE '/static/%' THEN 'static' WHEN path LIKE '/media/%' THEN 'media'
         WHEN path LIKE '/api/%' THEN 'api' WHEN path LIKE '/health%' THEN 'health'
         WHEN path LIKE '/%' THEN 'main' ELSE 'unrouted' END
"""


_ROUTE_PREFIXES = ("", "/login", "/register", "/reset-password", "/.git", "/static", "/media", "/api", "/healthz", "x")


@query(
    f"""
    SELECT page_id, path, {_ROUTE_SQL} AS route
    FROM (SELECT page_id, prefix || split_part(regexp_replace(url, '^https?://[^/]*', ''), '?', 1) AS path
          FROM pages, (SELECT unnest([{", ".join(repr(prefix) for prefix in _ROUTE_PREFIXES)}]) AS prefix))
    """
)
def route_class(spark, sf_dir):
    """Every page path as it is and below each prefix."""
    below = path_of(F.regexp_replace("url", "^https?://[^/]*", ""))
    pages = table(spark, sf_dir, "pages").select(
        "page_id", below.alias("below"), F.explode(F.lit(list(_ROUTE_PREFIXES))).alias("prefix")
    )
    return request_logs.with_route(pages.select("page_id", F.concat("prefix", "below").alias("path")))


@query(
    f"""
    SELECT route, count(*) AS requests, route NOT IN ('static', 'media', 'health', 'denied') AS logged
    FROM (SELECT {_ROUTE_SQL} AS route FROM ({_LOG_SQL}) WHERE value >= 1) GROUP BY route
    """
)
def route_counts(spark, sf_dir):
    parsed = access_logs.parse_proxy_lines(_log_lines(spark, sf_dir))
    return request_logs.route_counts(request_logs.with_route(access_logs.requests(parsed)))


@query(
    f"""
    SELECT remote_addr, path, route FROM (
        SELECT remote_addr, path, {_ROUTE_SQL} AS route FROM ({_LOG_SQL}) WHERE value >= 1
    ) WHERE route IN ('static', 'media', 'health', 'denied')
    """
)
def unexpected_requests(spark, sf_dir):
    parsed = access_logs.parse_proxy_lines(_log_lines(spark, sf_dir))
    routed = request_logs.with_route(access_logs.requests(parsed))
    return request_logs.unexpected_requests(routed).select("remote_addr", "path", "route")


def _bucket_sql(source: str, client: str, micros: str, id: str, period: int, burst: int) -> str:
    """The leaky bucket as a recursive query, one step per request of a client."""
    return f"""
    WITH RECURSIVE numbered AS (
        SELECT {client} AS client, {id} AS id, {micros} AS t,
               row_number() OVER (PARTITION BY {client} ORDER BY {micros}, {id}) AS place
        FROM {source}
    ),
    walk AS (
        SELECT client, id, place, t AS last, CAST(0 AS BIGINT) AS excess, true AS admitted
        FROM numbered WHERE place = 1
        UNION ALL
        SELECT n.client, n.id, n.place,
               CASE WHEN greatest(0, w.excess - (n.t - w.last) + {period}) > {burst * period} THEN w.last ELSE n.t END,
               CASE WHEN greatest(0, w.excess - (n.t - w.last) + {period}) > {burst * period} THEN w.excess
                    ELSE greatest(0, w.excess - (n.t - w.last) + {period}) END,
               greatest(0, w.excess - (n.t - w.last) + {period}) <= {burst * period}
        FROM walk w JOIN numbered n ON n.client = w.client AND n.place = w.place + 1
    )
    """


_TWELVE_HOURS = Limit(12 * 3600 * 1_000_000, 2)
_EVENT_WALK = _bucket_sql("events", "user_id", "epoch_us(ts)", "event_id", *_TWELVE_HOURS)


@query(f"{_EVENT_WALK} SELECT client AS user_id, id AS event_id, admitted FROM walk")
def admission(spark, sf_dir):
    return admit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", _TWELVE_HOURS)


@query(
    f"""{_EVENT_WALK} SELECT client AS user_id, count(*) FILTER (WHERE admitted) AS admitted,
    count(*) FILTER (WHERE NOT admitted) AS rejected FROM walk GROUP BY client"""
)
def admission_by_client(spark, sf_dir):
    decided = admit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", _TWELVE_HOURS)
    return admission_counts(decided, "user_id")


_HOT_LIMIT = Limit(5 * 60 * 1_000_000, 20)
_HOT_WALK = _bucket_sql(
    "(SELECT 'all' AS client, event_id, ts FROM events)", "client", "epoch_us(ts)", "event_id", *_HOT_LIMIT
)


@query(f"{_HOT_WALK} SELECT client, id AS event_id, admitted FROM walk")
def admission_one_client(spark, sf_dir):
    """All events as requests of one client, which then spreads over all partitions."""
    events = table(spark, sf_dir, "events").withColumn("client", F.lit("all"))
    return admit(events, "client", "ts", "event_id", _HOT_LIMIT)


# Log times pressed together, and few clients, so that the real limits reject.
_PRESSED, _CLIENTS = 50_000, 4


def _pressed_sql(route: str, path: str, limit: Limit) -> str:
    source = f"""(
        SELECT event_id, '10.1.0.' || CAST(user_id % {_CLIENTS} AS VARCHAR) AS remote_addr,
               epoch_us(time_local) // 1000000 // {_PRESSED} * 1000000 AS t
        FROM (SELECT l.*, e.user_id FROM ({_LOG_SQL}) l JOIN events e ON e.event_id = l.event_id)
        WHERE value >= 1 AND path = '{path}')"""
    walk = _bucket_sql(source, "remote_addr", "t", "event_id", *limit)
    return f"SELECT * FROM ({walk} SELECT '{route}' AS route, client AS remote_addr, id AS event_id, admitted FROM walk)"


@query(
    _pressed_sql("api", "/api/menu", request_logs.LIMITED_ROUTES["api"])
    + " UNION ALL "
    + _pressed_sql("auth", "/register", request_logs.LIMITED_ROUTES["auth"])
)
def replay_limits(spark, sf_dir):
    """The log of a busier shop: the same lines within seconds, from a few clients."""
    lines = _log_lines(
        spark, sf_dir,
        client=F.concat(F.lit("10.1.0."), F.col("user_id") % _CLIENTS),
        time=F.timestamp_seconds(F.floor(F.floor(micros(F.col("ts")) / 1_000_000) / _PRESSED)),
    )
    parsed = _parsed_requests(access_logs.parse_proxy_lines(lines))
    return request_logs.replay_limits(request_logs.with_route(parsed), "remote_addr", "time_local", "event_id")


# ------------------------------------------------------------------------------ streams


_SLICES = 4


def _time_slices(events: DataFrame) -> list[DataFrame]:
    """The events in equal spans of time, oldest first."""
    times = micros(F.col("ts"))
    first, last = events.agg(F.min(times), F.max(times)).first()
    width = (last - first) // _SLICES + 1
    starts = [first + i * width for i in range(_SLICES)]
    return [events.where((times >= start) & (times < start + width)) for start in starts]


def _event_slices(spark, sf_dir) -> list[DataFrame]:
    return _time_slices(table(spark, sf_dir, "events"))


def _slice_stream(spark, slices: list[DataFrame], folder: str) -> DataFrame:
    """The slices as they arrive in a folder; ``_deliver`` puts them there."""
    return spark.readStream.schema(slices[0].schema).parquet(f"{folder}/arriving/slice=*")


def _deliver(slices: list[DataFrame], folder: str, run: Callable[[], StreamingQuery]) -> None:
    """Slice after slice arrives, and each time a run of the stream takes what is there.

    A slice has as many files as tasks wrote it, not in order of time among themselves, and is one micro-batch.
    """
    for i, part in enumerate(slices):
        part.write.parquet(f"{folder}/arriving/slice={i}")
        run().awaitTermination()


@query(_PARSED_SQL)
def stream_log(spark, sf_dir):
    folder = scratch_dir(spark, "stream-log")
    parsed = streams.log_stream(spark, f"{folder}/lines/slice=*", "10 minutes")
    for i, part in enumerate(_event_slices(spark, sf_dir)):
        _log_lines(spark, sf_dir, events=part).write.text(f"{folder}/lines/slice={i}")
        streams.ingest_log(parsed, f"{folder}/parsed", f"{folder}/progress").awaitTermination()
    stored = spark.read.schema(parsed.schema).parquet(f"{folder}/parsed")
    return _parsed_requests(stored)


def _written(spark, stream: DataFrame, slices: list[DataFrame], folder: str) -> DataFrame:
    """What a stream has appended when all slices have arrived."""
    _deliver(slices, folder, lambda: streams.append_rows(stream, f"{folder}/out", f"{folder}/progress"))
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(f"{_EVENT_WALK} SELECT client AS user_id, id AS event_id, admitted FROM walk")
def stream_admission(spark, sf_dir):
    folder, slices = scratch_dir(spark, "stream-admission"), _event_slices(spark, sf_dir)
    arriving = _slice_stream(spark, slices, folder)
    decided = streams.admission_stream(arriving, "user_id", "ts", "event_id", _TWELVE_HOURS)
    return _written(spark, decided, slices, folder)


@query(
    """
    SELECT user_id, event_id, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)
    WHERE place = 1
    """
)
def stream_insert_if_absent(spark, sf_dir):
    folder, slices = scratch_dir(spark, "stream-insert"), _event_slices(spark, sf_dir)
    arriving = _slice_stream(spark, slices, folder)
    held = table(spark, sf_dir, "events").where("event_id < 0")
    added = streams.first_rows(arriving, ["user_id"], ["ts", "event_id"], held)
    return held.unionByName(_written(spark, added, slices, folder)).select("user_id", "event_id", "event_type")


@query(
    """
    SELECT event_id, user_id, ts, event_type FROM events
    """
)
def stream_distinct_events(spark, sf_dir):
    """Every slice of the events is delivered twice, the second time after the next slice has come."""
    folder = scratch_dir(spark, "stream-distinct")
    slices = _event_slices(spark, sf_dir)
    twice = [slices[0].unionByName(slices[0])]
    for before, part in zip(slices, slices[1:]):
        twice.append(part.unionByName(before.withColumn("event_type", F.lit("again"))))
    distinct = streams.distinct_rows(_slice_stream(spark, twice, folder), ["event_id"], "ts", "365 days")
    return _written(spark, distinct, twice, folder).select("event_id", "user_id", "ts", "event_type")


# ------------------------------------------------------------------------------ reports


@query(
    """
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest_status, max(ts) AS since
    FROM events GROUP BY user_id
    """
)
def latest_status(spark, sf_dir):
    return reports.latest_status(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query(
    """
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest_status, max(ts) AS since
    FROM events GROUP BY user_id
    """
)
def stream_latest_status(spark, sf_dir):
    """Changed users are stored after each micro-batch; their last state is read back."""
    folder, slices = scratch_dir(spark, "stream-status"), _event_slices(spark, sf_dir)
    latest = reports.latest_status(_slice_stream(spark, slices, folder), "user_id", "event_type", "ts", "event_id")
    _deliver(slices, folder, lambda: streams.store_changes(latest, f"{folder}/latest", f"{folder}/progress"))
    return streams.current_groups(spark, f"{folder}/latest", ["user_id"], latest.schema)


@query(
    """
    SELECT user_id, event_id, event_type, ts, lead(ts) OVER w AS until,
           epoch_us(lead(ts) OVER w) - epoch_us(ts) AS micros_in_status
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """
)
def dwell_time(spark, sf_dir):
    return reports.dwell_time(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query(
    """
    SELECT user_id, event_id, old_status, event_type, ts, lag(event_type) OVER w AS previous_status,
           old_status IS NOT DISTINCT FROM lag(event_type) OVER w AS linked
    FROM (SELECT *, CASE WHEN value < 50 THEN 'view' WHEN value < 90 THEN 'click' END AS old_status FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """
)
def chain_check(spark, sf_dir):
    old = F.when(F.col("value") < 50, "view").when(F.col("value") < 90, "click")
    history = table(spark, sf_dir, "events").withColumn("old_status", old)
    return reports.chain_check(history, "user_id", "old_status", "event_type", "ts", "event_id")


@query(
    """
    SELECT c_nationkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day, count(*) AS orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(10,2))) AS DECIMAL(20,2)) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
    """
)
def orders_by_day(spark, sf_dir):
    placed = views.join_columns(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", {"c_nationkey": "c_nationkey"}
    )
    return reports.orders_by_day(placed, "c_nationkey", "o_orderstatus", "o_orderdate", "o_totalprice")


_FAILED_SQL = """
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, user_id,
           count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) AS attempts
    FROM events GROUP BY ALL
"""


def _attempts(events: DataFrame) -> DataFrame:
    return events.select("ts", "user_id", (F.col("event_type") == "error").alias("failed"))


@query(_FAILED_SQL)
def failed_logins(spark, sf_dir):
    return reports.failed_logins(_attempts(table(spark, sf_dir, "events")), "user_id", "ts", "failed", "1 day")


@query(f"SELECT * FROM ({_FAILED_SQL}) WHERE window_end <= (SELECT max(ts) FROM events)")
def stream_failed_logins(spark, sf_dir):
    """Windows that the watermark has closed; the last one is still open."""
    folder, slices = scratch_dir(spark, "stream-logins"), _event_slices(spark, sf_dir)
    attempts = _attempts(_slice_stream(spark, slices, folder))
    windows = streams.failed_login_stream(attempts, "user_id", "ts", "failed", "1 day", "0 seconds")
    return _written(spark, windows, slices, folder).withColumns(
        {name: F.col(name).cast("timestamp_ntz") for name in ("window_start", "window_end")}
    )


@query(
    f"""
    SELECT user_id, count(*) AS live_sessions FROM ({_SESSIONS_SQL})
    WHERE ts <= TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-15' < expires_at GROUP BY user_id
    """
)
def live_sessions(spark, sf_dir):
    return reports.live_sessions(_sessions(spark, sf_dir), "user_id", "ts", "expires_at", _PURGE_TIME)


_STAGED_ORDERS = """
    SELECT o_orderpriority, o_orderdate, o_orderstatus, CAST(o_totalprice AS DECIMAL(10,2)) AS total FROM orders
"""


@query(
    f"""
    WITH first AS (
        SELECT o_orderpriority, o_orderdate, total,
               CASE WHEN o_orderstatus = 'P' AND year(o_orderdate) = 1995 THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM ({_STAGED_ORDERS})
    ),
    second AS (
        SELECT o_orderpriority, o_orderstatus, CASE WHEN hit THEN TIMESTAMP '1990-01-01' ELSE o_orderdate END AS o_orderdate,
               CASE WHEN hit THEN CAST(total - 100000 AS DECIMAL(10,2)) ELSE total END AS total
        FROM (SELECT *, o_orderstatus = 'O' AND total > 200000 AS hit FROM first)
    ),
    third AS (SELECT * FROM second WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW'))
    SELECT o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS day, count(*) AS orders, CAST(sum(total) AS DECIMAL(20,2)) AS total
    FROM third GROUP BY ALL
    """
)
def orders_by_day_incremental(spark, sf_dir):
    """The report is stored once; three batches of changes then cost as much as they touch."""
    path = f"{scratch_dir(spark, 'report')}/sums"
    names = ("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "total_amount")
    state = _orders(spark, sf_dir).select(*names)

    def record(before: DataFrame, after: DataFrame) -> None:
        deltas = reports.order_deltas(before, after, *names[1:])
        deltas.write.mode("append").parquet(path)

    record(state.where("false"), state)
    status, total = F.col("o_orderstatus"), F.col("total_amount")
    batches = [
        ((status == "P") & (F.year("o_orderdate") == 1995), {"o_orderstatus": F.lit("O")}),
        ((status == "O") & (total > 200000), {"o_orderdate": F.lit("1990-01-01").cast("timestamp_ntz"), "total_amount": money(total - 100000)}),
        ((status == "F") & (F.col("o_orderpriority") == "5-LOW"), None),
    ]
    for hit, changed in batches:
        before = state.where(hit)
        after = before.where("false") if changed is None else before.withColumns(changed)
        record(before, after)
        state = state.where(~hit).unionByName(after)
    stored = spark.read.parquet(path)
    merged = reports.merge_deltas(stored, stored.where("false"), ["o_orderpriority", "o_orderstatus", "day"])
    return reports.report_of(merged).withColumn("total", F.col("total").cast("decimal(20,2)"))


@query(
    f"""
    WITH steps AS (
        SELECT user_id, ts AS moment, 1 AS step, event_id AS id FROM ({_SESSIONS_SQL})
        UNION ALL SELECT user_id, expires_at, -1, event_id FROM ({_SESSIONS_SQL})
    ),
    live AS (
        SELECT user_id, moment, step, sum(step) OVER (PARTITION BY user_id ORDER BY moment, step, id ROWS UNBOUNDED PRECEDING) AS n FROM steps
        UNION ALL SELECT NULL, moment, step, sum(step) OVER (ORDER BY moment, step, id ROWS UNBOUNDED PRECEDING) FROM steps
    ),
    best AS (SELECT user_id, max(n) AS most FROM live GROUP BY user_id)
    SELECT b.user_id, CAST(b.most AS BIGINT) AS peak_sessions, min(l.moment) AS peak_at
    FROM best b JOIN live l ON l.user_id IS NOT DISTINCT FROM b.user_id AND l.n = b.most AND l.step = 1 GROUP BY b.user_id, b.most
    """
)
def session_peaks(spark, sf_dir):
    return reports.session_peaks(_sessions(spark, sf_dir), "user_id", "event_id", "ts", "expires_at")


_BURST_SQL = """
    SELECT user_id, min(ts) AS first_failure, max(ts) AS last_failure, count(*) AS failures FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (
            SELECT user_id, ts, event_id, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh
            FROM events WHERE event_type = 'error')
    ) GROUP BY user_id, burst HAVING count(*) >= 2
"""


@query(_BURST_SQL)
def failure_bursts(spark, sf_dir):
    return reports.failure_bursts(_attempts(table(spark, sf_dir, "events")), "user_id", "ts", "failed", "2 days", 2)


@query(f"SELECT * FROM ({_BURST_SQL}) WHERE last_failure + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)")
def stream_failure_bursts(spark, sf_dir):
    """Bursts that are over; slices of the events end inside others."""
    folder, slices = scratch_dir(spark, "stream-bursts"), _event_slices(spark, sf_dir)
    attempts = _attempts(_slice_stream(spark, slices, folder))
    bursts = streams.failure_burst_stream(attempts, "user_id", "ts", "failed", "2 days", 2, "0 seconds")
    return _written(spark, bursts, slices, folder).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_failure", "last_failure")})


_RANKS = (0.1, 0.5, 0.9, 0.99)


@query(
    f"""
    SELECT event_type, CAST(rank AS DOUBLE) AS rank, count(*) AS changes, true AS within_bound
    FROM (SELECT event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events), (VALUES {', '.join(f'({r})' for r in _RANKS)}) v(rank)
    WHERE until IS NOT NULL GROUP BY event_type, rank
    """
)
def dwell_quantiles(spark, sf_dir):
    """Quantiles from one sketch per status and day, and whether their true ranks keep the bound."""
    path = f"{scratch_dir(spark, 'dwell')}/sketches"
    dwells = reports.dwell_time(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")
    reports.dwell_sketches(dwells, "event_type", "ts", "micros_in_status").write.parquet(path)
    found = reports.dwell_quantiles(spark.read.parquet(path), "event_type", _RANKS)
    values = dwells.where("micros_in_status IS NOT NULL").groupBy("event_type", F.col("micros_in_status").alias("value")).count()
    least = values.join(found, "event_type").groupBy("event_type", "rank", "changes").agg(
        (F.coalesce(F.sum(F.when(F.col("value") < F.col("micros_in_status"), F.col("count"))), F.lit(0)) / F.first("changes")).alias("below"),
        (F.coalesce(F.sum(F.when(F.col("value") <= F.col("micros_in_status"), F.col("count"))), F.lit(0)) / F.first("changes")).alias("up_to"),
    )
    inside = (F.col("below") <= F.col("rank") + 0.001) & (F.col("up_to") >= F.col("rank") - 0.001)
    return least.select("event_type", "rank", "changes", inside.alias("within_bound"))


@query(
    """
    SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST(event_id AS INTEGER) ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
           false AS rejected FROM events WHERE event_id % 11 <> 0
    UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 11 = 0
    """
)
def stored_json(spark, sf_dir):
    """JSON stored as VARIANT and read by path: a repeated key keeps its last value, broken texts are rejects."""
    path = scratch_dir(spark, "variants")
    number, text = F.col("event_id"), F.col("props")
    given = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(number % 11 == 0, F.concat(F.lit("{"), text))
        .when(number % 7 == 0, F.concat(F.lit('{"k": 0, "k": '), number.cast("string"), F.lit("}"))).otherwise(text).alias("customizations"),
    )
    layout.store_variants(given, "customizations", f"{path}/rows", f"{path}/rejects")
    rows = spark.read.schema("event_id long, customizations variant").parquet(f"{path}/rows")
    rejects = spark.read.schema("event_id long, customizations string").parquet(f"{path}/rejects")
    return rows.select("event_id", variant_field(F.col("customizations"), "$.k", "int").alias("k"), F.lit(False).alias("rejected")).unionByName(
        rejects.select("event_id", F.lit(None).cast("int").alias("k"), F.lit(True).alias("rejected"))
    )


@query(
    """
    SELECT p_type, CAST(sum(CAST(l_quantity AS DECIMAL(10,2))) AS DECIMAL(30,2)) AS units,
           CAST(sum(CAST(l_quantity AS DECIMAL(10,2)) * CAST(l_extendedprice AS DECIMAL(10,2))) AS DECIMAL(38,4)) AS revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type
    """
)
def item_sales(spark, sf_dir):
    sold = reports.item_sales(
        table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"),
        "l_partkey", "p_partkey", "p_type", "l_quantity", "l_extendedprice",
    )
    return sold.select("p_type", F.col("units").cast("decimal(30,2)"), F.col("revenue").cast("decimal(38,4)"))


# ---------------------------------------------------------------------- driver contract


def entry(spark: SparkSession) -> DataFrame:
    """Open orders with customer and place names, newest first."""
    return active_orders(spark, "/root/testdata/sf0.001")


# The operators for training text live in a folder of their own, which may be absent.
try:
    from ordermill.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("ordermill.llm", "ordermill.llm.queries"):
        raise
else:
    _QUERIES.update(llm_queries.QUERIES)
    _SQL.update(llm_queries.SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
