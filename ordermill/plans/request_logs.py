"""Jobs over parsed access logs: route classes, log hygiene, limit replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ordermill.functions.routes import is_logged, route_class
from ordermill.operators.admission import (
    ADMITTED,
    API_LIMIT,
    AUTH_LIMIT,
    CLIENT,
    ID,
    KIND,
    Limit,
    as_requests,
    decide_requests,
)
from ordermill.session import cut_lineage

LIMITED_ROUTES: dict[str, Limit] = {"api": API_LIMIT, "auth": AUTH_LIMIT}


def with_route(requests: DataFrame, path: str = "path") -> DataFrame:
    return requests.withColumn("route", route_class(F.col(path)))


def route_counts(routed: DataFrame) -> DataFrame:
    """Requests per class, and whether that class belongs in the log at all."""
    return routed.groupBy("route").agg(F.count("*").alias("requests")).withColumn("logged", is_logged(F.col("route")))


def unexpected_requests(routed: DataFrame) -> DataFrame:
    """Requests of classes that the proxy does not log: a sign of a changed set-up."""
    return routed.where(~is_logged(F.col("route")))


def replay_limits(routed: DataFrame, client: str, time: str, id: str) -> DataFrame:
    """What the limits would have decided, for the routes that have one.

    A replay is approximate: log times are whole seconds and are taken at the end of a
    request, while the proxy decides at its start. The few columns needed are stored
    first, so that lines are parsed once and not again for the range sample.
    """
    routes = list(LIMITED_ROUTES)
    limited = routed.where(F.col("route").isin(*routes))
    kind = F.array_position(F.lit(routes), F.col("route")) - 1
    requests = cut_lineage(as_requests(limited, client, time, id, kind))
    return decide_requests(requests, list(LIMITED_ROUTES.values())).select(
        F.element_at(F.lit(routes), F.col(KIND) + 1).alias("route"),
        F.col(CLIENT).alias(client),
        F.col(ID).alias(id),
        F.col(ADMITTED).alias("admitted"),
    )
