import random

import pytest

from ordermill.llm import decontaminate
from tests.llm.conftest import ODD
from tests.llm.test_licenses import edit_distance

ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog while seven wizards watch from a hill."),
    (2, "A second passage of the benchmark that is quite different from the first one, and longer too, so that more edits pass."),
    (3, None),
    (4, "  "),
    (None, "an item without id"),
]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id bigint, text string, doc_id int")


def test_distance_equals_the_table_method():
    pick = random.Random(4)
    for _ in range(200):
        item = "".join(pick.choice("abc ") for _ in range(pick.randrange(1, 90)))
        text = "".join(pick.choice("abc ") for _ in range(pick.randrange(0, 120)))
        assert decontaminate.best_match(item, text)[0] == edit_distance(item, text)


def edited(text, edits, seed):
    pick, characters = random.Random(seed), list(text)
    for _ in range(edits):
        place = pick.randrange(len(characters))
        characters[place : place + pick.choice([0, 1])] = pick.choice(["", "q"])
    return "".join(characters)


def test_finds_what_brute_force_finds(documents, benchmark):
    rows = list(ODD)
    for seed in range(60):
        item = ITEMS[seed % 2][1]
        rows.append((100 + seed, f"before {edited(item, seed % 12, seed).upper() if seed % 3 else edited(item, seed % 12, seed)}\n\tafter"))
    rows.append((900, "filler words " * 100_000 + ITEMS[0][1] + " end"))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(documents(rows), benchmark).collect()}
    expected = {}
    for doc_id, text in rows[:-1]:
        for item_id, item in ITEMS[:2]:
            item, plain = decontaminate.plain(item), decontaminate.plain(text)
            distance = edit_distance(item, plain)
            if distance <= decontaminate.budget(len(item)):
                expected[(doc_id, item_id)] = distance  # no edit here joins words at the borders
    expected[(900, 1)] = 0
    assert got == expected
    clean = decontaminate.drop_contaminated(documents(rows), benchmark)
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted(
        (d for d, _ in rows if d not in {k for k, _ in expected}), key=repr
    )


def test_items_in_blocks_and_empty_tables(documents, benchmark, monkeypatch):
    rows = [(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, "clean")]
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 10)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(rows), benchmark).collect()} == {(1, 1), (2, 2)}
    nothing = benchmark.where("false")
    assert decontaminate.contaminated(documents(rows), nothing).collect() == []
    assert decontaminate.drop_contaminated(documents(rows), nothing).count() == 3
    assert decontaminate.contaminated(documents([]), benchmark).collect() == []


def test_items_without_id_and_a_word_more_or_less_in_a_short_item(documents, benchmark):
    short = ITEMS[0][1]
    rows = [
        (1, "here is An item without id and more"), (2, short.replace("seven ", "")), (3, short.replace("while", "while again")),
        (4, "a text of its own"), (5, short.replace("quick brown fox jumps", "slow grey cat sleeps")),
    ]
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(documents(rows), benchmark).collect()}
    assert got == {(1, None): 0, (2, 1): 6, (3, 1): 6}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(documents(rows), benchmark).collect()) == [4, 5]
    assert decontaminate.budget(1000, 0) == 0 and decontaminate.budget(39) == 0 and decontaminate.budget(40) == 5


SHORT = [("a", "4"), ("b", "yes"), ("c", "the answer is 4"), ("d", "Yes"), (None, "???"), ("e", "x" * 39), ("f", "y" * 30 + " " + "z" * 30)]


def test_short_items_are_whole_words_without_edits(documents, spark):
    benchmark = spark.createDataFrame(SHORT, "item_id string, text string")
    texts = [
        "Yesterday was the day", "Yes, of course", "the answer is 42", "So the answer is  4.", "14 40 x4 4x", "4", "what???", "the answers is 4",
        "x" * 39, "x" * 40, "xx " + "x" * 38 + "y", f"{'y' * 30}  {'z' * 30}", f"a{'y' * 30} {'z' * 30}b", f"{'y' * 29} {'z' * 30}", f"q{'y' * 30} {'z' * 28}", None, "",
        "yes", "yes",
    ]
    got = sorted((r.doc_id, r.item_id or "-", r.distance) for r in decontaminate.contaminated(documents(list(enumerate(texts))), benchmark).collect())
    hits = {
        1: "bd", 3: "ac", 5: "a", 6: "-", 7: "a", 8: "e", 11: "f", 12: "f", 13: "f", 14: "f", 17: "bd", 18: "bd",
    }
    assert [(d, i) for d, i, _ in got] == [(d, i) for d, items in hits.items() for i in items]
    assert {d: n for d, i, n in got if i == "f"} == {11: 0, 12: 2, 13: 1, 14: 3}
    kept = decontaminate.drop_contaminated(documents(list(enumerate(texts))), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if i not in hits]


def test_repeated_items_and_ties(documents, spark):
    item = "one passage of the test that is long enough to be found with edits"
    benchmark = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, item.upper(), 0)], "item_id bigint, text string, doc_id int")
    rows = [(1, f"{item} and {item}"), (2, f"x{item[1:]} then {item[:-1]}x"), (2, f"x{item[1:]} then {item[:-1]}x")]
    got = [(r.doc_id, r.item_id, r.distance, r.end_at) for r in decontaminate.contaminated(documents(rows), benchmark).collect()]
    size = len(item)
    # Of equal places the first counts.
    assert sorted(got) == [(1, 1, 0, size)] * 2 + [(1, 2, 0, size)] + [(2, 1, 1, size)] * 4 + [(2, 2, 1, size)] * 2


def test_groups_cover_all_pieces():
    for count in range(1, 12):
        groups = decontaminate.grouped(count)
        assert [n for g in groups for n in g] == list(range(count))
        assert all(len(g) == 2 for g in groups[:-1]) and len(groups[-1]) in ((1,) if count == 1 else (2, 3))


def test_random_edits_are_all_found():
    """Every text within the budget, wherever its edits lie, is found with its least distance."""
    pick = random.Random(21)
    for _ in range(300):
        item = " ".join("".join(pick.choice("abcde") for _ in range(pick.randrange(1, 8))) for _ in range(pick.randrange(9, 22)))
        if len(item) < decontaminate.LEAST_FUZZY:
            continue
        matcher = decontaminate.Matcher([(1, item)], decontaminate.ERROR_PERCENT)
        budget, characters = matcher.budgets[0], list(item)
        spots = [pick.randrange(len(item)) for _ in range(budget)] if pick.random() < 0.5 else [pick.randrange(8) + pick.randrange(len(item) - 8)] * budget
        for spot in spots[: pick.randrange(budget + 1)]:
            spot = min(spot, len(characters) - 1)
            characters[spot : spot + pick.choice([0, 1, 1])] = pick.choice(["", "q", "z"])
        text = f"one two {''.join(characters)} three"
        distance = edit_distance(item, text)
        if distance <= budget:
            found = matcher.matches(text)
            assert 0 in found and found[0][0] >= distance
        else:
            assert not matcher.matches(text)
