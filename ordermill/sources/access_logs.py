"""Access logs of the proxy and of the application server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The two line formats and their time format. Java regular expressions.
# A request that is not three words leaves the groups for its words empty.
_PROXY_REQUEST = r'"(([^" ]+) (([^"? ]*)[^" ]*) ([^" ]+)|[^"]*)"'
PROXY_LINE = (
    r"^(\S+) - (.*?) \[([^\]]*)\] " + _PROXY_REQUEST + r' (\d{3}) (\d+|-) "([^"]*)" "([^"]*)" "([^"]*)"$'
)
PROXY_FIELDS = (
    "remote_addr",
    "remote_user",
    "time_local",
    "request",
    "method",
    "target",
    "path",
    "protocol",
    "status",
    "body_bytes_sent",
    "referer",
    "user_agent",
    "x_forwarded_for",
)
_ESCAPED = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_APP_REQUEST = r'"(([^"\\ ]+) (([^"\\? ]*)[^"\\ ]*) ([^"\\ ]+)|' + _ESCAPED + ')"'
APP_LINE = (
    r"^(\S+) (\S+) (.*?) \[([^\]]*)\] "
    + _APP_REQUEST
    + r" (\d{3}) (\d+|-) "
    + f'"({_ESCAPED})" "({_ESCAPED})"$'
)
APP_FIELDS = (
    "remote_addr",
    "ident",
    "remote_user",
    "time_local",
    "request",
    "method",
    "target",
    "path",
    "protocol",
    "status",
    "body_bytes_sent",
    "referer",
    "user_agent",
)
TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"

# Servers escape control characters, so a line that holds this one is damaged.
_MARK = "\u0001"

# Fields in which a lone dash stands for nothing.
_OPTIONAL = ("ident", "remote_user", "body_bytes_sent", "referer", "user_agent", "x_forwarded_for")


# Words of the request; empty where it is not three words.
_REQUEST_WORDS = ("method", "target", "path", "protocol")


def parse_lines(lines: DataFrame, pattern: str, names: tuple[str, ...], column: str = "value") -> DataFrame:
    """One row per line: its fields, the line itself, and whether it was understood.

    The pattern runs one time per line. Its groups are joined by a mark and split
    again, which is much cheaper than one extraction per field. Exploding the single
    result keeps Spark from repeating that work in filters on the fields.
    """
    line = F.col(column)
    joined = F.regexp_replace(line, pattern, _MARK.join(f"${i + 1}" for i in range(len(names))))
    parts = F.when(~line.contains(_MARK), F.split(joined, _MARK))
    taken = lines.select(line.alias("line"), F.explode(F.array(parts)).alias("_parts"))
    whole = F.size("_parts") == len(names)

    def value(i: int, name: str) -> Column:
        text = F.when(whole, F.col("_parts")[i])
        if name in _OPTIONAL:
            text = F.nullif(text, F.lit("-"))
        if name in _REQUEST_WORDS:
            text = F.when(whole & (F.col("_parts")[names.index("method")] != ""), F.col("_parts")[i])
        if name == "time_local":
            return F.try_to_timestamp(text, F.lit(TIME_FORMAT))
        return text.try_cast({"status": "int", "body_bytes_sent": "long"}.get(name, "string"))

    parsed = taken.select("line", *(value(i, name).alias(name) for i, name in enumerate(names)))
    return parsed.withColumn("understood", F.col("time_local").isNotNull() & F.col("status").isNotNull())


def parse_proxy_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return parse_lines(lines, PROXY_LINE, PROXY_FIELDS, column)


def parse_app_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return parse_lines(lines, APP_LINE, APP_FIELDS, column)


def requests(parsed: DataFrame) -> DataFrame:
    """The understood lines, without the raw text."""
    return parsed.where("understood").drop("line", "understood")


def rejects(parsed: DataFrame) -> DataFrame:
    """The lines that do not follow the format."""
    return parsed.where(~F.col("understood")).select("line")


def read_proxy_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_proxy_lines(spark.read.text(path))


def read_app_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_app_lines(spark.read.text(path))


def render_proxy_lines(df: DataFrame, fields: dict[str, Column], *kept: str) -> DataFrame:
    """Write rows as proxy log lines; the inverse of parsing, used to replay tables."""

    def text(name: str) -> Column:
        if name == "time_local":
            return F.date_format(fields[name], TIME_FORMAT)
        return F.coalesce(fields[name].cast("string"), F.lit("-"))

    quoted = {"request", "referer", "user_agent", "x_forwarded_for"}
    pieces = []
    for name in PROXY_FIELDS:
        if name in _REQUEST_WORDS:
            continue
        if name == "time_local":
            pieces.append(F.concat(F.lit("["), text(name), F.lit("]")))
        elif name in quoted:
            pieces.append(F.concat(F.lit('"'), text(name), F.lit('"')))
        else:
            pieces.append(text(name))
    pieces.insert(1, F.lit("-"))
    return df.select(F.concat_ws(" ", *pieces).alias("value"), *kept)
