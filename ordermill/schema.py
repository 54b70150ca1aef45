"""The eleven tables as data: columns, keys, references, defaults, value rules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T


class Reference(NamedTuple):
    """A foreign key of a child table; ``cascade`` deletes children with the parent."""

    column: str
    parent: str
    parent_column: str
    cascade: bool = False


class Table(NamedTuple):
    columns: str
    key: str
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    references: tuple[Reference, ...] = ()
    defaults: dict[str, object] = {}
    allowed: dict[str, tuple[str, ...]] = {}
    not_negative: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    formats: dict[str, str] = {}
    serial: bool = False
    stamped: bool = False


class Marker(NamedTuple):
    """A default that is computed at insert time instead of stored as a literal."""

    name: str


NOW = Marker("now")
RANDOM_UUID = Marker("random uuid")

# Table layouts, keys, defaults and value lists of the data model.
# varchar lengths are checked by rules (DataFrames do not enforce them); json, uuid
# and inet values are strings with a format rule.
TABLES: dict[str, Table] = {
    "customers": Table(
        columns="""customer_id varchar(20), name varchar(100), phone_number varchar(20),
            email varchar(100), created_at timestamp_ntz, user_id int""",
        key="customer_id",
        required=("name", "phone_number"),
        unique=("phone_number", "email"),
        references=(Reference("user_id", "users", "user_id"),),
        defaults={"created_at": NOW},
    ),
    "addresses": Table(
        columns="""address_id int, customer_id varchar(20), street string, city varchar(50),
            state varchar(50), postal_code varchar(20), country varchar(50),
            latitude decimal(10,8), longitude decimal(11,8), is_default boolean,
            created_at timestamp_ntz""",
        key="address_id",
        required=("street", "city"),
        references=(Reference("customer_id", "customers", "customer_id"),),
        defaults={"country": "USA", "is_default": False, "created_at": NOW},
        serial=True,
    ),
    "restaurants": Table(
        columns="""restaurant_id varchar(20), name varchar(100), address string,
            phone varchar(20), is_active boolean, created_at timestamp_ntz""",
        key="restaurant_id",
        required=("name", "address"),
        defaults={"is_active": True, "created_at": NOW},
    ),
    "menu_items": Table(
        columns="""item_id varchar(20), restaurant_id varchar(20), name varchar(100),
            description string, price decimal(10,2), category varchar(50),
            is_available boolean, image_url varchar(255), created_at timestamp_ntz,
            updated_at timestamp_ntz""",
        key="item_id",
        required=("name", "price"),
        references=(Reference("restaurant_id", "restaurants", "restaurant_id"),),
        defaults={"is_available": True, "created_at": NOW, "updated_at": NOW},
        stamped=True,
    ),
    "users": Table(
        columns="""user_id int, public_id string, username varchar(50), email varchar(100),
            password_hash varchar(255), role varchar(20), is_active boolean,
            restaurant_id varchar(20), phone_number varchar(20), last_login timestamp_ntz,
            created_at timestamp_ntz, updated_at timestamp_ntz""",
        key="user_id",
        required=("username", "email", "password_hash"),
        unique=("public_id", "username", "email"),
        references=(Reference("restaurant_id", "restaurants", "restaurant_id"),),
        defaults={
            "public_id": RANDOM_UUID,
            "role": "employee",
            "is_active": True,
            "created_at": NOW,
            "updated_at": NOW,
        },
        allowed={"role": ("admin", "manager", "employee", "driver", "user")},
        formats={"public_id": "uuid"},
        serial=True,
        stamped=True,
    ),
    "orders": Table(
        columns="""order_id varchar(30), customer_id varchar(20), restaurant_id varchar(20),
            address_id int, order_status varchar(20), delivery_type varchar(10),
            special_instructions string, subtotal decimal(10,2), tax decimal(10,2),
            delivery_fee decimal(10,2), discount decimal(10,2), total_amount decimal(10,2),
            payment_method varchar(20), payment_status varchar(20),
            transaction_id varchar(100), driver_id int, created_at timestamp_ntz,
            estimated_delivery timestamp_ntz, delivered_at timestamp_ntz,
            updated_at timestamp_ntz""",
        key="order_id",
        required=("subtotal", "total_amount"),
        references=(
            Reference("customer_id", "customers", "customer_id"),
            Reference("restaurant_id", "restaurants", "restaurant_id"),
            Reference("address_id", "addresses", "address_id"),
            Reference("driver_id", "users", "user_id"),
        ),
        defaults={
            "order_status": "pending",
            "tax": 0,
            "delivery_fee": 0,
            "discount": 0,
            "payment_status": "pending",
            "created_at": NOW,
            "updated_at": NOW,
        },
        allowed={
            "order_status": (
                "pending",
                "confirmed",
                "preparing",
                "ready",
                "out_for_delivery",
                "delivered",
                "cancelled",
            ),
            "delivery_type": ("delivery", "pickup"),
            "payment_status": ("pending", "paid", "failed", "refunded"),
        },
        not_negative=("subtotal", "tax", "delivery_fee", "discount", "total_amount"),
        stamped=True,
    ),
    "order_items": Table(
        columns="""order_item_id int, order_id varchar(30), item_id varchar(20), quantity int,
            unit_price decimal(10,2), customizations string, created_at timestamp_ntz""",
        key="order_item_id",
        required=("quantity", "unit_price"),
        references=(
            Reference("order_id", "orders", "order_id", cascade=True),
            Reference("item_id", "menu_items", "item_id"),
        ),
        defaults={"created_at": NOW},
        not_negative=("unit_price",),
        positive=("quantity",),
        formats={"customizations": "json"},
        serial=True,
    ),
    "order_status_history": Table(
        columns="""history_id int, order_id varchar(30), old_status varchar(20),
            new_status varchar(20), changed_at timestamp_ntz, changed_by int""",
        key="history_id",
        required=("new_status",),
        references=(
            Reference("order_id", "orders", "order_id"),
            Reference("changed_by", "users", "user_id"),
        ),
        defaults={"changed_at": NOW},
        serial=True,
    ),
    "login_attempts": Table(
        columns="""attempt_id int, user_id int, ip_address string, user_agent string,
            success boolean, attempted_at timestamp_ntz""",
        key="attempt_id",
        references=(Reference("user_id", "users", "user_id"),),
        defaults={"attempted_at": NOW},
        formats={"ip_address": "inet"},
        serial=True,
    ),
    "user_sessions": Table(
        columns="""session_id varchar(128), user_id int, token string, ip_address string,
            user_agent string, expires_at timestamp_ntz, created_at timestamp_ntz""",
        key="session_id",
        required=("token", "expires_at"),
        references=(Reference("user_id", "users", "user_id"),),
        defaults={"created_at": NOW},
        formats={"ip_address": "inet"},
    ),
    "password_reset_tokens": Table(
        columns="""token_id int, user_id int, token varchar(255), expires_at timestamp_ntz,
            used boolean, created_at timestamp_ntz""",
        key="token_id",
        required=("token", "expires_at"),
        unique=("token",),
        references=(Reference("user_id", "users", "user_id", cascade=True),),
        defaults={"used": False, "created_at": NOW},
        serial=True,
    ),
}


def declared(table: str) -> T.StructType:
    """The column types as declared, varchar lengths included."""
    return T.StructType.fromDDL(TABLES[table].columns)


def struct(table: str) -> T.StructType:
    """The column types as a DataFrame holds them: varchar(n) is a plain string."""
    return T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.VarcharType) else f.dataType)
            for f in declared(table).fields
        ]
    )


def lengths(table: str) -> dict[str, int]:
    return {
        f.name: f.dataType.length
        for f in declared(table).fields
        if isinstance(f.dataType, T.VarcharType)
    }


def decimals(table: str) -> dict[str, tuple[int, int]]:
    return {
        f.name: (f.dataType.precision, f.dataType.scale)
        for f in declared(table).fields
        if isinstance(f.dataType, T.DecimalType)
    }


def children(table: str) -> list[tuple[str, Reference]]:
    """Every (child table, reference) that points at ``table``."""
    return [
        (name, reference)
        for name, spec in TABLES.items()
        for reference in spec.references
        if reference.parent == table
    ]
