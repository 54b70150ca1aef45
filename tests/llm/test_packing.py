import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from ordermill.llm import packing
from tests.llm.conftest import ODD


def test_counts_are_packed_whole():
    pick = random.Random(2)
    for _ in range(40):
        capacities = pick.choice([(8,), (4, 8, 16), (16, 64), (10, 25, 60)])
        counts = {n: pick.randrange(1, 50) for n in pick.sample(range(1, capacities[-1] + 1), min(8, capacities[-1]))}
        packed = packing.pack_counts(counts, capacities)
        total = defaultdict(int)
        for bins in packed:
            assert 0 < bins.filled() <= bins.capacity
            assert bins.capacity == min(c for c in capacities if c >= bins.filled())
            for length, items in bins.runs:
                total[length] += items * bins.count
        assert dict(total) == counts


def test_ranges_give_each_item_its_place():
    packed = packing.pack_counts({3: 7, 5: 4, 8: 2, 1: 9}, (4, 8, 16))
    for length, table in packing._ranges(packed).items():
        assert table[0][0] == 0 and (table[:, 0][1:] > table[:, 0][:-1]).all()


def test_pieces_fill_bins_without_overlap(documents, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 5)
    pick = random.Random(8)
    rows = [(i + 1000, "w " * pick.choice([1, 2, 30, 30, 30, 30, 64, 65, 200])) for i in range(150)] + ODD
    got = packing.pack(documents(rows), capacities=(16, 32, 64)).collect()
    texts, bins = defaultdict(list), defaultdict(list)
    for r in got:
        texts[r.doc_id].append((r.start, r.length))
        if r.length:
            bins[(r.bin_id, r.bin_capacity)].append((r.bin_offset, r.length))
        else:
            assert r.bin_id is None
    for doc_id, text in rows:
        if doc_id not in (None, 7):
            at = 0
            for start, length in sorted(texts[doc_id]):
                assert start == at
                at += length
            assert at == len(re.findall(r"[^ \t\n\x0b\f\r]+", text or ""))
    assert len(bins) == len({b for b, _ in bins})
    for (_, capacity), placed in bins.items():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity == min(c for c in (16, 32, 64) if c >= at)
    assert len(texts[7]) == 2 and len(texts[None]) == 2


def test_other_measures_and_empty_tables(documents):
    assert packing.pack(documents([])).collect() == []
    got = packing.pack(documents([(1, "abcdef")]), F.length("text").cast("bigint"), (4,)).collect()
    assert sorted((r.piece, r.start, r.length) for r in got) == [(0, 0, 4), (1, 4, 2)]


def test_bins_are_filled_well():
    pick = random.Random(3)
    counts = defaultdict(int)
    for _ in range(5000):
        counts[min(4096, int(pick.lognormvariate(5.5, 1)) + 1)] += 1
    packed = packing.pack_counts(dict(counts))
    used = sum(b.capacity * b.count for b in packed)
    assert sum(n * c for n, c in counts.items()) / used > 0.97


def one_by_one(counts, capacities, cost):
    """Best fit in the plain way: item after item, longest first. The size of new bins is chosen once per length."""
    bins, left = [], sum(length * n for length, n in counts.items())
    for length in sorted(counts, reverse=True):
        left -= length * counts[length]
        chosen = None
        for placed in range(counts[length]):
            fitting = [b for b in bins if b[0] - sum(b[1]) >= length]
            if fitting:
                best = min(fitting, key=lambda b: (b[0] - sum(b[1]), b[0]))
            else:
                if chosen is None:
                    waiting = counts[length] - placed

                    def price(capacity):
                        each = capacity // length
                        return cost(capacity) / (each * length + min(capacity - each * length, left / -(-waiting // each)))

                    chosen = min((c for c in sorted(capacities) if c >= length), key=lambda c: (price(c), c))
                best = (chosen, [])
                bins.append(best)
            best[1].append(length)
    return sorted((min(c for c in capacities if c >= sum(items)), sorted(items)) for _, items in bins)


def test_equals_best_fit_one_by_one():
    pick = random.Random(12)
    for _ in range(150):
        capacities = pick.choice([(8,), (4, 8, 16), (16, 64), (10, 25, 60)])
        counts = {n: pick.randrange(1, 25) for n in pick.sample(range(1, capacities[-1] + 1), min(pick.randrange(1, 9), capacities[-1]))}
        got = []
        for b in packing.pack_counts(counts, capacities):
            got += [(b.capacity, sorted(n for n, times in b.runs for _ in range(times)))] * b.count
        # Bins of one size with equal room are alike to best fit: what is compared are the sizes and how full they are.
        plain = one_by_one(counts, capacities, packing.sequence_cost)
        assert sorted((c, sum(items)) for c, items in got) == sorted((c, sum(items)) for c, items in plain)


def test_repeated_rows_are_spread(documents, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 10)
    got = packing.pack(documents([(5, "a b c")] * 100), capacities=(4, 8)).collect()
    assert len({(r.bin_id, r.bin_offset) for r in got}) == 100 and {r.length for r in got} == {3}
