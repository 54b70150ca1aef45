import hashlib

from pyspark.sql import functions as F

from ordermill.llm import multiset
from tests.llm.conftest import ODD


def lanes(text):
    total = [0] * multiset.LANES
    for line in (text or "").split("\n") if text else []:
        digest = hashlib.sha256(line.encode()).hexdigest()
        for i in range(multiset.TOUCHED):
            lane = int(digest[16 * i : 16 * i + 2], 16) % multiset.LANES
            total[lane] = (total[lane] + int(digest[16 * i + 2 : 16 * i + 6], 16)) % 65536
    return total


def likeness(a, b):
    used = sum(1 for x, y in zip(a, b) if x or y)
    return sum(1 for x, y in zip(a, b) if x == y != 0) / used if used else 1.0


def test_equals_brute_force(documents):
    rows = ODD + [(20, "a\nb\nc"), (21, "c\nb\na"), (22, "a\nb\nc\n"), (23, "😀é" * 50 + "\nx"), (-4, "long line " * 100_000), (1 << 60, "\n\n")]
    got = multiset.fingerprints(documents(rows)).collect()
    distinct = sorted({(d is None, -(d or 0), hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest(), t or "") for d, t in rows})
    expected = []
    for doc_id, text in rows:
        text = text or ""
        key = (doc_id is None, -(doc_id or 0), hashlib.md5(f"{'' if doc_id is None else doc_id}:{text}".encode()).hexdigest(), text)
        following = distinct[(distinct.index(key) + 1) % len(distinct)]
        after, next_id = following[3], None if following[0] else -following[1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, changed = lanes(text), lanes(edited)
        expected.append(
            (doc_id, len(text), next_id, hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:04x}" for x in own),
             "".join(f"{x:04x}" for x in changed), likeness(own, changed), likeness(own, lanes(after)))
        )
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_order_does_not_matter_and_paragraphs_come_and_go(spark):
    row = spark.createDataFrame([("a\nb\nb\nc", "c\nb\na\nb", "a\nb\nc", "b")], "x string, y string, z string, b string").select(
        *(multiset.fingerprint(F.col(c)).alias(c) for c in "xyzb")
    ).select("x", "y", "z", multiset.plus(F.col("z"), F.col("b")).alias("more"), multiset.minus(F.col("x"), F.col("b")).alias("less")).first()
    assert row.x == row.y == row.more != row.z == row.less


def test_one_document_and_none(documents):
    assert multiset.fingerprints(documents([])).collect() == []
    row = multiset.fingerprints(documents([(1, "abcdef")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0


def test_every_document_has_its_neighbour_across_many_runs(spark, documents, many_partitions):
    rows = [(i * 3, f"text {i}") for i in range(500)]
    keyed = documents(rows).select("doc_id", F.col("text").alias("key"), F.lit(1).cast("bigint").alias("n_chars"))
    got = {r.key: r.next_key for r in multiset.following(keyed).collect()}
    assert got == {f"text {i}": f"text {(i - 1) % 500}" for i in range(500)}


def test_shared_share_holds_at_every_length(spark):
    rows = []
    for size in (12, 51, 100, 200, 406, 3000):
        lines = [f"{size} line {i}" for i in range(2 * size)]
        rows.append((size, "\n".join(lines[:size]), "\n".join(lines[size // 3 : size + size // 3]), "\n".join(lines[size:]), "\n".join(lines[:size][::-1])))
    table = spark.createDataFrame([*rows, (0, "", None, "x", "")], "size int, a string, cut string, other string, turned string")
    of = {c: multiset.sketch(F.col(c)).alias(c) for c in ("a", "cut", "other", "turned")}
    table = table.select("size", *of.values())
    got = table.select("size", *(multiset.shared(F.col("a"), F.col(c)).alias(c) for c in of if c != "a")).collect()
    for r in got:
        assert r.turned == 1.0
        if r.size:
            assert abs(r.cut - 0.5) < 0.2 and r.other < 0.2
    assert [(r.cut, r.other) for r in got if r.size == 0] == [(1.0, 0.0)]
    same = table.select((multiset.minus(multiset.plus(F.col("a"), F.col("other")), F.col("other")) == F.col("a")).alias("same"))
    assert all(r.same for r in same.collect())
