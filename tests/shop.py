"""A small, whole set of tables with the odd cases that the given data lacks."""

from datetime import datetime

from ordermill import schema
from ordermill.sources.tables import conform, literal_rows

DAY = datetime(2024, 1, 10)


def order(order_id, customer="C1", place="R1", status="pending", created=DAY, **more):
    return {
        "order_id": order_id,
        "customer_id": customer,
        "restaurant_id": place,
        "order_status": status,
        "subtotal": "10.00",
        "total_amount": "11.00",
        "created_at": created,
        **more,
    }


ROWS = {
    "restaurants": [{"restaurant_id": "R1", "name": "One", "address": "A 1"}, {"restaurant_id": "R2", "name": "Two", "address": "B 2"}],
    "users": [
        {"user_id": 1, "username": "ada", "email": "ada@x.example", "password_hash": "h", "role": "driver", "restaurant_id": "R1"},
        {"user_id": 2, "username": "ben", "email": "ben@x.example", "password_hash": "h", "role": "user"},
    ],
    "customers": [
        {"customer_id": "C1", "name": "Cid", "phone_number": "1"},
        {"customer_id": "C2", "name": "Dot", "phone_number": "2"},
    ],
    "addresses": [{"address_id": 1, "customer_id": "C1", "street": "S", "city": "T"}],
    "menu_items": [{"item_id": "I1", "restaurant_id": "R1", "name": "Soup", "price": "4.50"}],
    "orders": [
        order("O1", created=datetime(2024, 1, 10)),
        order("O2", status="delivered"),
        order("O3", status="cancelled"),
        order("O4", status=None),
        order("O5", customer=None),
        order("O6", place=None),
        order("O7", customer="C2", place="R2", status="ready", created=None),
        order("O8", status="preparing", created=datetime(2024, 1, 12)),
    ],
    "order_items": [
        {"order_item_id": 1, "order_id": "O1", "item_id": "I1", "quantity": 2, "unit_price": "4.50"},
        {"order_item_id": 2, "order_id": "O2", "item_id": "I1", "quantity": 1, "unit_price": "4.50"},
    ],
    "order_status_history": [
        {"history_id": 1, "order_id": "O2", "old_status": None, "new_status": "pending", "changed_at": DAY}
    ],
    "login_attempts": [{"attempt_id": 1, "user_id": 1, "ip_address": "10.0.0.1", "success": True}],
    "user_sessions": [
        {"session_id": "s1", "user_id": 1, "token": "t", "expires_at": datetime(2024, 1, 10)},
        {"session_id": "s2", "user_id": 1, "token": "t", "expires_at": datetime(2024, 1, 9, 23, 59, 59)},
    ],
    "password_reset_tokens": [{"token_id": 1, "user_id": 2, "token": "r", "expires_at": DAY}],
}


def typed(rows, table):
    from decimal import Decimal

    from pyspark.sql import types as T

    money = {f.name for f in schema.struct(table).fields if isinstance(f.dataType, T.DecimalType)}
    return [{c: Decimal(v) if c in money and v is not None else v for c, v in row.items()} for row in rows]


def literal(spark, table, rows):
    return literal_rows(spark, table, typed(rows, table))


def shop(spark, **replaced):
    """All tables; ``replaced`` gives other rows for some of them."""
    return {
        table: conform(literal(spark, table, replaced.get(table, ROWS[table])), schema.struct(table))
        for table in schema.TABLES
    }
