"""Which rule of the proxy serves a request path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Path prefixes of the proxy's routes, and the two request limits.
AUTH_PREFIXES = ("/login", "/register", "/reset-password")
HIDDEN_MARK = "/."
PREFIX_ROUTES = (
    ("/static/", "static"),
    ("/media/", "media"),
    ("/api/", "api"),
    ("/health", "health"),
    ("/", "main"),
)
UNLOGGED_ROUTES = ("static", "media", "health", "denied")


def path_of(target: Column) -> Column:
    """The path of a request target, without its query string."""
    return F.substring_index(target, "?", 1)


def route_class(path: Column) -> Column:
    """auth and hidden-file rules come first, then the longest matching prefix.

    Hidden files under an auth path count as auth, since that rule is listed before.
    No prefix begins with another one except ``/``, which comes last, so the first
    match is the longest. Anything that is no path at all is ``unrouted``.
    """
    auth = F.lit(False)
    for prefix in AUTH_PREFIXES:
        auth = auth | path.startswith(prefix)
    route = F.when(auth, "auth").when(path.contains(HIDDEN_MARK), "denied")
    for prefix, name in PREFIX_ROUTES:
        route = route.when(path.startswith(prefix), name)
    return route.otherwise("unrouted")


def is_logged(route: Column) -> Column:
    """Whether requests of this class are written to the access log at all."""
    return ~route.isin(*UNLOGGED_ROUTES)
