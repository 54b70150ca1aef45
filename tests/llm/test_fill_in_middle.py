import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ordermill.llm import fill_in_middle
from tests.llm.conftest import ODD

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    """The rule step by step, with a loop over the units."""
    text = text or ""
    units = UNIT.findall(text)
    digest = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ROWS = ODD + [(100 + i, f"  word{i} and <{'PSM'[i % 3]} some more  words < P> here {i}" + " tail" * (i % 7) + "\n" * (i % 3)) for i in range(120)]
ROWS += [(300 + i, f"a text with {mark} inside") for i, mark in enumerate(["<P>", "<S>", "<M>"])]
ROWS += [(400 + i, "one" + " many words" * 200_000 + " " * 50_000) for i in range(4)] + [(410 + i, "x" * 300_000) for i in range(4)] + [(420 + i, " " * 300_000) for i in range(4)]


def test_equals_the_rule_and_is_read_back(documents):
    moved = fill_in_middle.fill_in_middle(documents(ROWS))
    back = moved.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in back), key=repr)
    assert got == sorted(((d, *by_hand(d, t), t or "") for d, t in ROWS), key=repr)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_empty_table_and_columns(documents):
    moved = fill_in_middle.fill_in_middle(documents([]))
    assert moved.collect() == [] and moved.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_marks_that_could_be_read_in_two_ways_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("<M>", "x<M>y", "z")):
        with pytest.raises(ValueError):
            fill_in_middle.Settings(prefix_mark=marks[0], suffix_mark=marks[1], middle_mark=marks[2])


def test_rates_and_other_marks(documents):
    settings = fill_in_middle.Settings(seed="7", fim_percent=100, spm_percent=0, prefix_mark="[pre]", suffix_mark="(suf)", middle_mark="{mid}")
    rows = [(i, f"some words of text {i}") for i in range(20)]
    moved = fill_in_middle.fill_in_middle(documents(rows), settings)
    got = {r.doc_id: (r.form, r.back) for r in moved.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), settings)).collect()}
    assert got == {i: ("psm", text) for i, text in rows}
