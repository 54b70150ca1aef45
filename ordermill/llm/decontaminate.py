"""Benchmark passages inside documents, with edits.

A test item of m characters may have k errors: m * error_percent / 100 and those of an
average word (``WORD``) more, where that is no more than an eighth of the item. It is split into
k + 1 pieces, of which a copy with at most k edits leaves one untouched. An automaton
finds the exact hits of all pieces in each whole text, and Myers' bit-parallel
algorithm verifies the few characters around each. The pieces lie in groups of two, the last of three if
their number is odd: some group of g pieces has fewer than g errors, so beside its untouched piece another one has
at most one error and half of it untouched. Hits without such a half at its place need no verification, and no match is
lost by that. Texts and items are compared in
lower case with single spaces. Items under ``LEAST_FUZZY`` characters are found without edits only, as one
character would change what they say.

A match is made of whole words: where a letter or digit of the item meets one of the text beside it, that
counts as one more error (in ``distance`` as well), so an item without errors left is not found inside a longer word.

The items are dealt into blocks of bounded size (``ITEM_BLOCK`` characters) and stored in the shared folder, from where
the tasks read them; neither the driver nor the plan holds any. There is one pass over the documents per block.

Null and empty texts, and items without characters, match nothing. Items without an id are
searched like all others; their rows have a null item_id. Ids may be of any type. An item is reported once per row of
``documents``, at the place with fewest errors, of several such places the first. Repeated items and repeated documents give a
row each. Columns other than those named are left out, whatever their names; empty tables match nothing. Memory
grows with the longest text and one block.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ordermill.llm.stored import stored
from ordermill.session import scratch_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ERROR_PERCENT = 6
WORD = 6  # an average word and a blank
LEAST_FUZZY = 40  # characters of an item from which on edits are allowed
ITEM_BLOCK = 4_000_000


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, error_percent: int = ERROR_PERCENT) -> int:
    if length < LEAST_FUZZY:
        return 0
    share = length * error_percent // 100
    return max(share, min(share + WORD, length // 8)) if error_percent else 0


def best_match(item: str, text: str, whole=None) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``text``, and where that part ends: of several places
    the first for which ``whole`` holds, if there is one.

    Bit i of the vertical differences tells whether the distance of the first i + 1 characters
    is one more (up) or one less (down) than that of the first i.
    """
    size = len(item)
    full, top = (1 << size) - 1, 1 << (size - 1)
    places: dict[str, int] = {}
    for i, character in enumerate(item):
        places[character] = places.get(character, 0) | 1 << i
    up, down, distance = full, 0, size
    best, end, good = size, 0, False
    for at, character in enumerate(text, 1):
        equal = places.get(character, 0)
        steps = (((equal & up) + up) ^ up) | equal | down
        raised = down | (full & ~(steps | up))
        lowered = up & steps
        if raised & top:
            distance += 1
        elif lowered & top:
            distance -= 1
        raised, lowered = (raised << 1) & full, (lowered << 1) & full
        steps = equal | down
        up = lowered | (full & ~(steps | raised))
        down = raised & steps
        if distance < best:
            best, end, good = distance, at, whole is None or whole(at)
        elif distance == best and not good and end and whole(at):
            end, good = at, True
    return best, end


def _in_word(text: str, place: int) -> bool:
    """Whether a letter or digit stands on both sides of a place."""
    return 0 < place < len(text) and text[place - 1].isalnum() and text[place].isalnum()


def _split_words(text: str, start: int, end: int) -> int:
    """At how many of its two borders text[start:end] cuts a word."""
    return _in_word(text, start) + _in_word(text, end)


def grouped(count: int) -> list[range]:
    """The numbers of ``count`` pieces in groups of two, the last one of three if need be."""
    if count < 2:
        return [range(count)]
    starts = list(range(0, count - count % 2, 2))
    return [range(a, b) for a, b in zip(starts, [*starts[1:], count])]


def companions(item: str, edges: list[int]) -> list[list[tuple[int, str, int]]]:
    """Of each piece: (place from the piece's start, text, how far it may be moved) of the halves of the others of its group."""
    listed: list[list[tuple[int, str, int]]] = [[] for _ in edges[1:]]
    for group in grouped(len(edges) - 1):
        for piece in group:
            for other in group:
                if other != piece:
                    a, b = edges[other], edges[other + 1]
                    middle = (a + b) // 2
                    listed[piece] += [(x - edges[piece], item[x:y], len(group) - 1) for x, y in ((a, middle), (middle, b))]
    return listed


class Matcher:
    """All items of one block; built once per task."""

    def __init__(self, items: list[tuple[object, str]], error_percent: int) -> None:
        self.items = items
        self.budgets = [budget(len(item), error_percent) for _, item in items]
        seeds: dict[str, list[tuple[int, int, list]]] = {}
        for i, (_, item) in enumerate(items):
            count = self.budgets[i] + 1
            edges = [len(item) * j // count for j in range(count + 1)]
            for a, b, halves in zip(edges, edges[1:], companions(item, edges)):
                seeds.setdefault(item[a:b], []).append((i, a, halves))
        self.automaton = ahocorasick.Automaton()
        for piece, users in seeds.items():
            self.automaton.add_word(piece, (len(piece), users))
        self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """Of each item found: the least distance and the end of that place in ``text``."""
        found: dict[int, tuple[int, int]] = {}
        regions: dict[int, list[list[int]]] = {}
        for last, (length, users) in self.automaton.iter(text):
            hit = last + 1 - length
            for i, place, halves in users:
                size, slack = len(self.items[i][1]), self.budgets[i]
                at = hit - place
                if slack:
                    for offset, half, moved in halves:
                        low = hit + offset - moved
                        if text.find(half, low if low > 0 else 0, hit + offset + len(half) + moved) >= 0:
                            break
                    else:
                        continue
                else:  # the one piece is the whole item
                    if i not in found and not _split_words(text, at, at + size):
                        found[i] = (0, at + size)
                    continue
                start, end = max(0, at - slack), min(len(text), at + size + slack)
                listed = regions.setdefault(i, [])
                if listed and start <= listed[-1][1]:
                    listed[-1][0], listed[-1][1] = min(listed[-1][0], start), max(listed[-1][1], end)
                else:
                    listed.append([start, end])
        for i, listed in regions.items():
            for start, end in listed:
                place = self.verified(i, text, start, end)
                if place is not None and (i not in found or place[0] < found[i][0]):
                    found[i] = place
        return found

    def verified(self, i: int, text: str, start: int, end: int) -> tuple[int, int] | None:
        """The distance and end of the item in text[start:end], if it is within its budget."""
        item = self.items[i][1]
        exact = text.find(item, start, end)
        while exact >= 0:
            if not _split_words(text, exact, exact + len(item)):
                return 0, exact + len(item)
            exact = text.find(item, exact + 1, end)
        part = text[start:end]
        distance, stop = best_match(item, part, lambda at: not _in_word(text, start + at))
        if distance > self.budgets[i]:
            return None
        # From its end backwards, the same method finds where the match begins.
        stop += start
        _, back = best_match(item[::-1], text[start:stop][::-1], lambda at: not _in_word(text, stop - at))
        distance += _split_words(text, stop - back, stop)
        return (distance, stop) if distance <= self.budgets[i] else None


_PLACE = [("distance", pa.int32()), ("item_chars", pa.int32()), ("end_at", pa.int64())]


def _found(folder: str, id_type: str, error_percent: int):
    def search(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        where, path = fs.FileSystem.from_uri(folder)
        stored_items = parquet.read_table(path, filesystem=where)
        ids = stored_items.column("item_id")
        items = [(i, t) for i, t in zip(ids.to_pylist(), map(plain, stored_items.column("text").to_pylist())) if t]
        matcher = Matcher(items, error_percent)
        kind = pa.list_(pa.struct([("item_id", ids.type), *_PLACE]))
        for texts in arrays:
            rows = []
            for text in texts:
                hits = matcher.matches(plain(text.as_py())) if items else {}
                rows.append([(items[i][0], distance, len(items[i][1]), end) for i, (distance, end) in hits.items()])
            yield pa.array(rows, kind)

    return F.arrow_udf(
        search, f"array<struct<item_id:{id_type},distance:int,item_chars:int,end_at:bigint>>", F.ArrowUDFType.SCALAR_ITER
    )


def _item_blocks(benchmark: DataFrame) -> list[str]:
    """The folders of the blocks of items."""
    items = benchmark.select("item_id", "text").where(F.trim("text") != "")
    size = items.agg(F.coalesce(F.sum(F.char_length("text").cast("bigint")), F.lit(0))).first()[0]
    if not size:
        return []
    blocks = -(-size // ITEM_BLOCK)
    folder = scratch_dir(benchmark.sparkSession, "items")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    dealt.repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    # A block that no item was dealt to has no folder.
    filled = sorted(row.block for row in dealt.select("block").distinct().collect())
    return [f"{folder}/block={block}" for block in filled]


def contaminated(documents: DataFrame, benchmark: DataFrame, error_percent: int = ERROR_PERCENT) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, item_chars, end_at.

    end_at counts characters of the text in lower case with single spaces.
    """
    texts, parts, id_type = documents.select("doc_id", "text"), [], benchmark.schema["item_id"].dataType.simpleString()
    for folder in _item_blocks(benchmark):
        hits = texts.select("doc_id", F.explode(_found(folder, id_type, error_percent)("text")).alias("hit"))
        parts.append(hits.select("doc_id", "hit.*"))
    if not parts:
        nothing = "doc_id", F.lit(None).cast(id_type).alias("item_id"), F.lit(0).alias("distance"), F.lit(0).alias("item_chars")
        return texts.select(*nothing, F.lit(0).cast("bigint").alias("end_at")).where("false")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, error_percent: int = ERROR_PERCENT) -> DataFrame:
    """The rows of ``documents`` that hold no test item; columns are those given."""
    result, id_type = documents, benchmark.schema["item_id"].dataType.simpleString()
    for number, folder in enumerate(_item_blocks(benchmark)):
        if number:  # a task holds the items of one block at a time
            result = stored(result, "clean")
        result = result.where(F.size(_found(folder, id_type, error_percent)("text")) == 0)
    return result
