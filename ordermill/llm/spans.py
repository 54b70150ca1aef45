"""Hashes of words and character runs, taken straight from Arrow string buffers.

Texts stay UTF-8 bytes. One running sum per block of bytes gives the 64-bit hash of
any run of bytes by two look-ups, so that neither words nor n-grams become Python
strings. Blocks hold about a megabyte; a longer text is cut into several blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Executors get this module's functions with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

BLOCK = 1 << 20


class Block(NamedTuple):
    """``data[bounds[i]:bounds[i + 1]]`` belongs to row ``rows[i]`` of the batch."""

    rows: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    whole: bool  # False: a part of one long text


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


# ASCII white space, the first bytes of characters, and A-Z lower-cased.
WHITE = byte_table(b" \t\n\x0b\x0c\r")
CHARACTER = (np.arange(256) & 0xC0) != 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(texts: pa.Array, cut: np.ndarray, overlap: int = 0, limit: int = BLOCK) -> Iterator[Block]:
    """The texts of a batch (null: empty) in blocks of about ``limit`` bytes.

    A longer text is cut before bytes of ``cut``; each of its parts but the first
    repeats ``overlap`` bytes, moved back to the start of a character.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        low, high = int(offsets[row]), int(offsets[last])
        if high - low <= limit:
            yield Block(np.arange(row, last), offsets[row : last + 1] - low, data[low:high], True)
        else:
            yield from _parts(row, data[low:high], cut, overlap, limit)
        row = last
    # Workers live on after a task: what earlier batches held goes back to the system.
    pa.default_memory_pool().release_unused()


def _parts(row: int, data: np.ndarray, cut: np.ndarray, overlap: int, limit: int) -> Iterator[Block]:
    start = 0
    while start < len(data):
        end = min(start + limit, len(data))
        if end < len(data):
            places = np.flatnonzero(cut[data[start + 1 : end + 1]])
            if len(places):
                end = start + 1 + int(places[-1])
            else:  # one run longer than a block: go on to where it ends
                end += 1
                while end < len(data):
                    places = np.flatnonzero(cut[data[end : end + limit]])
                    if len(places):
                        end += int(places[0])
                        break
                    end = min(end + limit, len(data))
        first = max(0, start - overlap)
        while first and not CHARACTER[data[first]]:
            first -= 1
        part = data[first:end]
        yield Block(np.array([row]), np.array([0, len(part)]), part, False)
        start = end


class Hasher:
    """64-bit hashes of runs of bytes: a sum of bytes times powers, modulo 2^64."""

    def __init__(self) -> None:
        self.size = 0

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= self.size:
            self.size = max(len(data) + 1, BLOCK + 64)
            self.powers = np.full(self.size, _FACTOR).cumprod()
            self.inverses = np.full(self.size, _INVERSE).cumprod()
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        return sums

    def runs(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.inverses[starts]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread all bits over the whole word (a bijection of 64-bit numbers)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_places(block: Block, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``in_word`` bytes; none goes over a text's border."""
    size = len(block.data)
    member = np.zeros(size + 1, bool)
    member[:size] = in_word[block.data]
    border = np.zeros(size + 1, bool)
    border[block.bounds] = True
    before = np.zeros(size + 1, bool)
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | border))
    ends = np.flatnonzero(before & (~member | border))
    return starts, ends


def part_of(block: Block, places: np.ndarray) -> np.ndarray:
    """The index into ``block.rows`` of each byte place."""
    return np.searchsorted(block.bounds, places, side="right") - 1
