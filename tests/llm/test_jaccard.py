import random
import re

import pytest

from ordermill.llm import jaccard
from ordermill.llm.components import components
from tests.llm.conftest import ODD


def brute_force(rows, width, percent):
    """n_shingles of each row, and the components over doc_ids."""
    sets = []
    for doc_id, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        run = min(width, len(words))
        sets.append((doc_id, {tuple(words[i : i + run]) for i in range(len(words) - run + 1)} if words else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, one) in enumerate(sets):
        for b, other in sets[:i]:
            shared = len(one & other)
            if a is not None and b is not None and shared and 100 * shared >= percent * len(one | other):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=repr)


def made_up(seed):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    common = [pick.choice(vocabulary) for _ in range(60)]
    rows = []
    for base in range(12):
        words = [pick.choice(vocabulary) for _ in range(pick.choice([3, 8, 40, 150]))]
        if base % 3 == 0:
            words += common
        for _ in range(pick.choice([1, 2, 9])):
            copy = list(words)
            for _ in range(pick.choice([0, 1, 2, len(words) // 20, len(words) // 9])):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            rows.append((len(rows) * 3 + 1000, " ".join(copy)))
    return rows


@pytest.mark.parametrize("width, percent, seed", [(4, 85, 1), (5, 80, 2), (1, 80, 3), (3, 50, 4)])
def test_equals_brute_force(documents, width, percent, seed):
    rows = made_up(seed) + [(i * 1000 + 1 if i else i, t) for i, t in ODD]
    result = jaccard.similar_documents(documents(rows), width, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in result.collect()), key=repr) == brute_force(rows, width, percent)


def test_one_id_with_two_texts_is_one_document(documents):
    rows = [(5, "a b c d e f"), (5, "g h i j k l"), (9, "a b c d e f"), (3, "g h i j k l"), (8, "other words here on this line")]
    got = {(r.doc_id, r.component_id) for r in jaccard.similar_documents(documents(rows)).collect()}
    assert got == {(5, 3), (9, 3), (3, 3), (8, 8)}


def test_large_group_of_copies(documents):
    """Copies and near copies of one text; links go through a chain too."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words)) for i in range(300, 400)]
    for i in range(100):
        copy = list(words)
        copy[i] = "changed"
        rows.append((i, " ".join(copy)))
    got = {r.component_id for r in jaccard.similar_documents(documents(rows), 4, 85).collect()}
    assert got == {0}


def test_empty_table(documents):
    assert jaccard.similar_documents(documents([])).collect() == []
    assert jaccard.drop_near_duplicates(documents([])).collect() == []


def test_one_of_each_group_stays(documents):
    rows = made_up(7) + ODD
    table = documents(rows)
    kept = jaccard.drop_near_duplicates(table)
    assert kept.columns == table.columns
    expected = {d for d, n, c in brute_force(rows, 5, 80) if d is not None and d == c}
    got = [r.doc_id for r in kept.collect()]
    assert {d for d in got if d is not None} == expected
    assert len([d for d in got if d is not None]) == len(expected)
    assert got.count(None) == 2


def test_components_of_chains_and_rings(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (200, 150)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)} | {(200, 150), (150, 150)}
