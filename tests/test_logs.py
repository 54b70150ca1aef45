from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ordermill.functions.routes import path_of, route_class
from ordermill.plans import request_logs
from ordermill.sources import access_logs

PROXY = [
    '10.0.0.1 - - [10/Oct/2024:13:55:36 +0000] "GET /api/menu?x=1&y=2 HTTP/1.1" 200 512 "https://a.example/" "Mozilla/5.0 (X11)" "1.2.3.4, 5.6.7.8"',
    '10.0.0.2 - ann lee [10/Oct/2024:15:55:36 +0200] "POST /login HTTP/2.0" 429 0 "-" "-" "-"',
    '2001:db8::1 - - [10/Oct/2024:13:55:38 +0000] "\\x16\\x03\\x01" 400 157 "-" "-" "-"',
    '10.0.0.3 - - [10/Oct/2024:13:55:39 +0000] "GET / HTTP/1.1" 200 - "-" "curl/8" "-"',
]
TORN = [
    '10.0.0.1 - - [10/Oct/2024:13:55:36 +0000] "GET /api/me',
    '10.0.0.1 - - [99/Foo/2024:13:55:36 +0000] "GET / HTTP/1.1" 200 1 "-" "-" "-"',
    "",
    "a\u0001b\u0001c\u0001d\u0001e\u0001f\u0001g\u0001h\u0001i\u0001j\u0001k\u0001l\u0001m",
]


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_proxy_lines(spark):
    parsed = access_logs.parse_proxy_lines(lines(spark, PROXY + TORN))
    found = access_logs.requests(parsed).collect()
    assert [r.remote_addr for r in found] == ["10.0.0.1", "10.0.0.2", "2001:db8::1", "10.0.0.3"]
    first, second, third, fourth = found
    assert (first.method, first.target, first.path, first.protocol) == ("GET", "/api/menu?x=1&y=2", "/api/menu", "HTTP/1.1")
    assert (first.status, first.body_bytes_sent, first.referer) == (200, 512, "https://a.example/")
    assert first.x_forwarded_for == "1.2.3.4, 5.6.7.8"
    assert second.remote_user == "ann lee" and second.user_agent is None
    in_utc = F.col("time_local").cast("timestamp_ntz").alias("t")
    moments = [r.t for r in access_logs.requests(parsed).select(in_utc).collect()]
    assert moments[:2] == [datetime(2024, 10, 10, 13, 55, 36)] * 2
    assert third.request == "\\x16\\x03\\x01"
    assert (third.method, third.target, third.path, third.protocol) == (None,) * 4
    assert fourth.body_bytes_sent is None
    assert sorted(r.line for r in access_logs.rejects(parsed).collect()) == sorted(TORN)


def test_proxy_log_files(spark, tmp_path):
    (tmp_path / "access.log").write_text("\n".join(PROXY + TORN[:1]) + "\n")
    assert access_logs.requests(access_logs.read_proxy_log(spark, str(tmp_path))).count() == 4
    assert access_logs.rejects(access_logs.read_proxy_log(spark, str(tmp_path))).count() == 1


def test_app_lines(spark, tmp_path):
    good = [
        '10.0.0.9 - - [10/Oct/2024:13:55:36 +0000] "POST /orders HTTP/1.1" 201 - "-" "say \\"hi\\" now"',
        '10.0.0.9 - bob [10/Oct/2024:13:55:36 +0000] "GET /a?b HTTP/1.1" 200 7 "http://r.example/" "' + "u" * 20000 + '"',
    ]
    (tmp_path / "app.log").write_text("\n".join(good + ["broken"]) + "\n")
    parsed = access_logs.read_app_log(spark, str(tmp_path))
    found = sorted(access_logs.requests(parsed).collect(), key=lambda r: r.status)
    assert [(r.status, r.body_bytes_sent, r.path) for r in found] == [(200, 7, "/a"), (201, None, "/orders")]
    assert found[1].user_agent == 'say \\"hi\\" now'
    assert len(found[0].user_agent) == 20000
    assert access_logs.rejects(parsed).count() == 1


@pytest.mark.parametrize("size", [9, 60000])
def test_long_fields_are_kept_whole(spark, size):
    line = f'1.1.1.1 - - [10/Oct/2024:13:55:36 +0000] "GET /{"p" * size} HTTP/1.1" 200 1 "-" "{"a" * size}" "-"'
    row = access_logs.parse_proxy_lines(lines(spark, [line])).first()
    assert len(row.path) == size + 1 and len(row.user_agent) == size


def test_pattern_runs_once_per_line(spark):
    parsed = access_logs.requests(access_logs.parse_proxy_lines(lines(spark, PROXY)))
    plan = request_logs.with_route(parsed).where("route = 'api'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_routes(spark):
    expected = {
        "/login": "auth",
        "/login/.x": "auth",
        "/register": "auth",
        "/reset-password/1": "auth",
        "/api/.env": "denied",
        "/a/.git/config": "denied",
        "/.well-known/x": "denied",
        "/static/a.css": "static",
        "/static": "main",
        "/media/a.png": "media",
        "/api/orders": "api",
        "/api": "main",
        "/health": "health",
        "/healthz": "health",
        "/API/x": "main",
        "/": "main",
        "/x/login": "main",
        "*": "unrouted",
        None: "unrouted",
    }
    df = spark.createDataFrame([(p,) for p in expected], "path string")
    found = df.select("path", route_class(F.col("path")).alias("route")).collect()
    assert {r.path: r.route for r in found} == expected


def test_path_drops_the_query(spark):
    df = spark.createDataFrame([("/a?b=/static/",), ("/a",)], "t string")
    assert [r.p for r in df.select(path_of(F.col("t")).alias("p")).collect()] == ["/a", "/a"]


def test_log_jobs(spark):
    def line(addr, second, path):
        return f'{addr} - - [10/Oct/2024:13:55:{second:02d} +0000] "GET {path} HTTP/1.1" 200 1 "-" "-" "-"'

    texts = [line("1.1.1.1", 1, "/login")] * 5 + [line("1.1.1.1", 14, "/login")]
    texts += [line("2.2.2.2", 1, "/api/x")] * 22 + [line("2.2.2.2", 1, "/static/x")] * 3
    parsed = access_logs.requests(access_logs.parse_proxy_lines(lines(spark, texts)))
    routed = request_logs.with_route(parsed).withColumn("id", F.monotonically_increasing_id())
    counts = {r.route: (r.requests, r.logged) for r in request_logs.route_counts(routed).collect()}
    assert counts == {"auth": (6, True), "api": (22, True), "static": (3, False)}
    assert request_logs.unexpected_requests(routed).count() == 3
    replay = request_logs.replay_limits(routed, "remote_addr", "time_local", "id")
    found = {(r.route, r.admitted): r["count"] for r in replay.groupBy("route", "admitted").count().collect()}
    assert found == {("auth", True): 5, ("auth", False): 1, ("api", True): 21, ("api", False): 1}
