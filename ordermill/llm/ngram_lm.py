"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and read from mapped files.

Tokens are runs of characters other than ASCII white space, A-Z lower-cased, then one end of text. A token's
context is what stands before it in its text, at most order - 1 tokens; the first token follows a mark
of the beginning, which is never predicted.

Counting. Tasks sort the 64-bit hashes of each block of tokens, count equal ones, merge the blocks of a stretch and pass
them on in sorted arrays, rows of one shard of the hash space each; equal n-grams so combine before each shuffle. A shard's
arrays are merged in one task; shards follow the amount of text, so that each stays of one size, and
hashes deal the n-grams out evenly whatever word is frequent. All merges go slice by slice of the hash space, so that a
task holds its arrays and the temporary arrays of one slice, and no row is larger than a slice. The words come first: their place in
the sorted order is their id. Then come n-grams from the highest order down. Below the highest, an n-gram's
count is the number of different words before it (its occurrences where it starts a text), as a by-product of
the level above. The same pass gives each context its total and how many words follow it
one, two, and three or more times.

Model. A shard is one file: its hashes in order, then the counts in the same order. The files lie in the shared
folder and workers map them into memory, so tasks of a machine share the pages that they use, and no
task loads the model. A lookup sorts the hashes of a block of texts and searches each shard's
part of them. The folder must be a path that every machine mounts.

Probability of w after context h: (c(hw) - D(c(hw))) / c(h) + g(h) * p(w | h without its first
token), down to the uniform distribution over all words and one unknown word. The discounts
D1, D2 and D3 of each order come from its numbers of n-grams counted 1 to 4 times; where these give
no discounts in range (small corpora), they are 0.5, 1 and 1.5.

Null and empty texts are the end alone. Without training text every token has probability 1. Repeated rows
count and are scored each for itself; texts over a megabyte are read in parts with their context. Columns other
than doc_id and text are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ordermill.llm.spans import LOWER, WHITE, Hasher, blocks, mixed, part_of, word_places
from ordermill.llm.stored import stored
from ordermill.session import scratch_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = np.uint64(0x5D588B656C078965)  # stands for the hash of the end of a text
_FACTOR = np.uint64(0xD1342543DE82EF95)
FLUSH = 1 << 21  # tokens that a task holds before it passes their counts on
SHARD_TOKENS = 1 << 21  # tokens of text for which there is one shard
SLICE = 1 << 15  # n-grams that are merged at a time, about
DENSE = 1 << 15  # ids per shard of the one-word level
MAPPED = 256  # files that a task keeps open
NOTHING = -2  # in place of an id, before the beginning of a text; -1 is an unknown word
_COUNTS = 5  # below the highest order: count, total as context, words that follow it 1, 2, and 3 or more times
SMALL_CORPUS = (0.5, 1.0, 1.5)


@dataclass(frozen=True)
class Model:
    folder: str
    order: int
    shards: int  # of n-grams of two and more words; a power of two
    bases: tuple[int, ...]  # first id of each shard of words; fewer shards than above
    words: int  # different tokens
    tokens: int  # of the training texts
    discounts: tuple[tuple[float, float, float], ...]  # by order, from 1
    first_total: int  # sum of the one-word level's counts
    first_rest: float  # what its discounts leave to the uniform distribution

    def id_type(self) -> type:
        return np.uint32 if self.words < (1 << 32) - 2 else np.uint64

    def count_type(self) -> type:
        """Of counts on their way, and of the files of the highest order."""
        return np.uint32 if self.tokens < 1 << 32 else np.int64


# ------------------------------------------------------------------ tokens


def token_runs(texts: pa.Array, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, hash of each token, whether the run goes on with the text of the run before)."""
    word = ~WHITE
    open_row = None  # a text in parts, whose end is still to come

    def end(row):
        return np.array([row]), np.array([END]), True

    for block in blocks(texts, WHITE):
        if open_row is not None and block.rows[0] != open_row:
            yield end(open_row)
            open_row = None
        starts, ends = word_places(block, word)
        tokens = mixed(hasher.runs(hasher.sums(LOWER[block.data]), starts, ends))
        if block.whole:
            sizes = np.bincount(part_of(block, starts), minlength=len(block.rows))
            yield np.repeat(block.rows, sizes + 1), np.insert(tokens, np.cumsum(sizes), END), False
        else:
            yield np.full(len(tokens), block.rows[0]), tokens, open_row is not None
            open_row = block.rows[0]
    if open_row is not None:
        yield end(open_row)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    bits = shards.bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams, given the ids of their words from first to last."""
    keys = np.zeros(len(columns[0]), np.uint64)
    for ids in columns:
        keys = mixed(keys * _FACTOR + ids.astype(np.uint64) + np.uint64(1))
    return keys


def _by_shard(shards: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    """One row per shard; ``shards`` rises. ``counts`` has a row per n-gram."""
    edges = np.flatnonzero(np.diff(shards, prepend=-1))
    parts = list(zip(edges, np.append(edges[1:], len(shards))))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shards[edges], pa.int64()),
            pa.array([b"".join(c[a:b].tobytes() for c in columns) for a, b in parts], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in parts], pa.binary()),
        ],
        ["shard", "grams", "counts"],
    )


_CHUNKS = "shard bigint, grams binary, counts binary"


Run = tuple[np.ndarray, list[np.ndarray], np.ndarray]  # rising keys of n-grams, the ids of their words, a row of counts for each


def _reduced(keys: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> Run:
    """Distinct keys, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    sums = np.add.reduceat(counts[order], first, axis=0, dtype=np.int64) if len(first) else counts.astype(np.int64)
    return keys[first], [c[order[first]] for c in columns], sums


def _counted(keys: np.ndarray, columns: list[np.ndarray], values: int, kind: type) -> Run:
    """Distinct keys and how often they occur, the first of ``values`` counts."""
    keys, first, times = np.unique(keys, return_index=True, return_counts=True)
    counts = np.zeros((len(keys), values), kind)
    counts[:, 0] = times
    return keys, [c[first] for c in columns], counts


def _merged(runs: list[Run]) -> Iterator[Run]:
    """The runs as one, in order, by slices of the keys' range that hold about ``SLICE`` n-grams each."""
    runs = [run for run in runs if len(run[0])]
    if not runs:
        return
    low, high = min(int(keys[0]) for keys, _, _ in runs), max(int(keys[-1]) for keys, _, _ in runs)
    slices = -(-sum(len(keys) for keys, _, _ in runs) // SLICE)
    inner = np.array([low + (high - low) * i // slices for i in range(1, slices)], np.uint64)
    edges = [[0, *np.searchsorted(keys, inner).tolist(), len(keys)] for keys, _, _ in runs]
    for i in range(slices):
        here = [(run, slice(e[i], e[i + 1])) for run, e in zip(runs, edges) if e[i] < e[i + 1]]
        if here:
            columns = zip(*([c[part] for c in run[1]] for run, part in here))
            keys, counts = (np.concatenate([run[place][part] for run, part in here]) for place in (0, 2))
            yield _reduced(keys, [np.concatenate(c) for c in columns], counts)


def _received(chunks: pa.Table, width: int, kind: type, values: int, count_kind: type, key) -> list[Run]:
    """The rows of a shard, as they lie in the table's memory."""
    runs = []
    for grams, counts in zip(chunks.column("grams"), chunks.column("counts")):
        columns = list(np.frombuffer(grams.as_buffer(), kind).reshape(width, -1))
        runs.append((key(columns), columns, np.frombuffer(counts.as_buffer(), count_kind).reshape(-1, values)))
    return runs


# ------------------------------------------------------------------- files


def _file(folder: str, level: int, shard: int) -> str:
    return f"{folder}/{level}/{int(shard):08d}"


def _write(path: str, *arrays: np.ndarray) -> None:
    """Under a name of its own first, so that a repeated or parallel attempt leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with open(attempt, "wb") as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).data)
    os.replace(attempt, path)


class Store:
    """The mapped files of one model; those not used for longest are closed."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, OrderedDict()
        self.bases = np.array(model.bases)

    def file(self, level: int, shard: int, width: int) -> tuple[np.ndarray, int]:
        """The bytes of a file, and how many entries of ``width`` bytes it has."""
        found = self.open.pop((level, shard), None)
        if found is None:
            path = _file(self.model.folder, level, shard)
            empty = not os.path.exists(path) or not os.path.getsize(path)  # a shard without entries has no file
            found = np.zeros(0, np.uint8) if empty else np.memmap(path, np.uint8, "r").view(np.ndarray)
            if len(self.open) >= MAPPED:
                self.open.popitem(last=False)
        self.open[(level, shard)] = found
        return found, len(found) // width

    def look_up(self, level: int, keys: np.ndarray, kind: type, values: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each key: its place in its shard (-1: absent), and its counts (0 if absent)."""
        unique, back = np.unique(keys, return_inverse=True)
        counts = np.zeros((len(unique), values), np.int64)
        places = np.full(len(unique), -1, np.int64)
        shards = _shard_of(unique, self.model.shards if level else len(self.bases))
        edges = np.flatnonzero(np.diff(shards, prepend=-1))
        size = np.dtype(kind).itemsize * values
        for a, b in zip(edges, np.append(edges[1:], len(unique))):
            data, entries = self.file(level, int(shards[a]), 8 + size)
            if not entries:
                continue
            known = data[: 8 * entries].view(np.uint64)
            at = np.searchsorted(known, unique[a:b])
            at[at == entries] = 0
            hit = np.flatnonzero(known[at] == unique[a:b])
            rows = data[8 * entries :].view(kind).reshape(entries, values)
            counts[a + hit] = rows[at[hit]]
            places[a + hit] = at[hit]
        return places[back], counts[back]

    def ids(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and occurrences of tokens."""
        places, counts = self.look_up(0, tokens, np.int64, 1)
        return np.where(places < 0, -1, self.bases[_shard_of(tokens, len(self.bases))] + places), counts[:, 0]

    def first_level(self, ids: np.ndarray) -> np.ndarray:
        """The counts of single words, by id; zeros for -1."""
        out = np.zeros((len(ids), _COUNTS), np.int64)
        unique, back = np.unique(ids, return_inverse=True)
        rows = np.zeros((len(unique), _COUNTS), np.int64)
        shards = np.where(unique >= 0, unique // DENSE, -1)
        edges = np.flatnonzero(np.diff(shards, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(unique))):
            shard = int(shards[a])
            data, entries = self.file(1, shard, 8 * _COUNTS)
            rows[a:b] = data.view(np.int64).reshape(entries, _COUNTS)[unique[a:b] - shard * DENSE]
        return rows[back] if len(ids) else out


# ---------------------------------------------------------------- counting


def _count_words(shards: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def out():
            for keys, _, counts in _merged(held):
                yield _by_shard(_shard_of(keys, shards), [keys], counts.astype(np.uint32))
            held.clear()

        for batch in batches:
            for _, tokens, _ in token_runs(batch.column(0), hasher):
                held.append(_counted(tokens, [], 1, np.uint32))
                size += len(tokens)
                if size >= FLUSH:
                    size = 0
                    yield from out()
        if size:
            yield from out()

    return counted


def _word_files(folder: str):
    def write(chunks: pa.Table) -> pa.Table:
        shard = chunks.column("shard")[0].as_py()
        keys, _, counts = zip(*_merged(_received(chunks, 1, np.uint64, 1, np.uint32, lambda columns: columns[0])))
        _write(_file(folder, 0, shard), *keys, *counts)
        return pa.table({"shard": [shard], "words": [sum(map(len, keys))], "tokens": [sum(int(c.sum()) for c in counts)]})

    return write


def _columns(model: Model, ids: np.ndarray, before: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The ids at distance order - 1 to 0 before each token, and how many stand before it (with the beginning).

    ``before`` are the ids that a run goes on from; ``starts`` marks first tokens of a text.
    """
    whole = np.concatenate([before, ids])
    place = np.arange(len(ids)) + len(before)
    begin = np.maximum.accumulate(np.where(starts, place, -1)) if len(ids) else place
    # Tokens since the beginning; all that stands before it in a run that goes on belongs to the text.
    inside = np.where(begin >= 0, place - begin, len(whole))
    columns = []
    for distance in range(model.order - 1, -1, -1):
        there = np.where(place >= distance, whole[np.maximum(place - distance, 0)], NOTHING)
        columns.append(np.where(distance <= inside, there, np.where(distance == inside + 1, model.words, NOTHING)))
    return columns, np.sum([c != NOTHING for c in columns[:-1]], axis=0)


def _runs(model: Model, texts: pa.Array, hasher: Hasher, store: Store):
    """(row, id, occurrences, word columns, length of context) of each run of tokens."""
    span = model.order - 1
    before = np.zeros(0, np.int64)
    for rows, tokens, goes_on in token_runs(texts, hasher):
        ids, occurrences = store.ids(tokens)
        starts = np.append(True, rows[1:] != rows[:-1])[: len(rows)]
        if goes_on and len(starts):
            starts[0] = False
        if not goes_on:
            before = np.zeros(0, np.int64)
        elif len(before) < span and model.words not in before:  # the beginning is near
            before = np.append(model.words, before)
        columns, context = _columns(model, ids, before, starts)
        yield rows, ids, occurrences, columns, context
        last = np.flatnonzero(starts)
        before = np.concatenate([before, ids])[-span:] if not len(last) else ids[last[-1] :][-span:]


def _count_grams(model: Model, level: int):
    """Chunks of the n-grams of ``level`` words; below the highest order, of those at the beginning of texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, store, held, size = Hasher(), Store(model), [], 0
        values = 1 if level == model.order else _COUNTS

        def out():
            for keys, columns, counts in _merged(held):
                yield _by_shard(_shard_of(keys, model.shards), columns, counts.astype(model.count_type()))
            held.clear()

        for batch in batches:
            for _, _, _, columns, context in _runs(model, batch.column(0), hasher, store):
                chosen = context >= level - 1 if level == model.order else (context == level - 1) & (columns[-level] == model.words)
                grams = [c[chosen].astype(model.id_type()) for c in columns[-level:]]
                held.append(_counted(gram_keys(grams), grams, values, model.count_type()))
                size += len(grams[0])
                if size >= FLUSH:
                    size = 0
                    yield from out()
        if size:
            yield from out()

    return counted


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


_PARTIAL = pa.schema([("shard", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary()), ("of_counts", pa.list_(pa.int64()))])


def _gram_files(model: Model, level: int):
    """Writes a shard's file; gives chunks for the level below, and how many n-grams were counted 1 to 4 times."""
    values = 1 if level == model.order else _COUNTS

    def write(chunks: pa.Table) -> pa.Table:
        shard = chunks.column("shard")[0].as_py()
        runs = _received(chunks, level, model.id_type(), values, model.count_type(), gram_keys)
        stored_keys, stored_counts, below, of_counts = [], [], [], np.zeros(4, np.int64)
        for keys, columns, counts in _merged(runs):
            # Contexts alone (such as the beginning of a text) are in the file, yet are no n-grams of this level.
            stored_keys.append(keys)
            stored_counts.append(counts.astype(model.count_type()) if level == model.order else counts)
            real = counts[:, 0] > 0
            own = counts[real, 0]
            of_counts += _of_counts(own)
            columns = [c[real] for c in columns]
            context = np.zeros((len(own), _COUNTS), np.int64)
            context[:, 1], context[:, 2], context[:, 3], context[:, 4] = own, own == 1, own == 2, own > 2
            suffix = np.zeros((len(own), _COUNTS), np.int64)
            suffix[:, 0] = 1
            both = [np.concatenate([a, b]) for a, b in zip(columns[:-1], columns[1:])]
            key = both[0].astype(np.uint64) if level == 2 else gram_keys(both)
            key, both, sums = _reduced(key, both, np.concatenate([context, suffix]))
            below.append((key, both, sums.astype(model.count_type())))
        _write(_file(model.folder, level, shard), *stored_keys, *stored_counts)
        batches = []
        for key, both, sums in _merged(below):
            shards = (key // np.uint64(DENSE)).astype(np.int64) if level == 2 else _shard_of(key, model.shards)
            batch = _by_shard(shards, both, sums.astype(model.count_type()))
            notes = [None if batches else of_counts.tolist()] + [None] * (batch.num_rows - 1)
            batches.append(pa.RecordBatch.from_arrays([*batch.columns, pa.array(notes, pa.list_(pa.int64()))], schema=_PARTIAL))
        return pa.Table.from_batches(batches, _PARTIAL)

    return write


def _first_files(model: Model):
    """Writes the one-word level by id; gives its counts of counts and totals."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = rows = None
        for batch in batches:
            if rows is None:
                shard = batch.column("shard")[0].as_py()
                rows = np.zeros((min(DENSE, model.words + 1 - shard * DENSE), _COUNTS), np.int64)
            # The ids of one row of the table are distinct.
            for ids, _, counts in _received(batch, 1, model.id_type(), _COUNTS, model.count_type(), lambda columns: columns[0].astype(np.int64)):
                rows[ids - shard * DENSE] += counts
        _write(_file(model.folder, 1, shard), rows)
        own = rows[:, 0]
        yield pa.record_batch({"of_counts": [[*_of_counts(own), int((own > 2).sum()), int(own.sum())]]})

    return write


def discounts(of_counts: list[int]) -> tuple[float, float, float]:
    """For n-grams counted once, twice, and three or more times."""
    n1, n2, n3, n4 = of_counts
    if not (n1 and n2 and n3):
        return SMALL_CORPUS
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return found if all(0 < d <= i for i, d in enumerate(found, 1)) else SMALL_CORPUS


def fit(training: DataFrame, order: int = 2) -> Model:
    """Count the texts of ``training`` (text) and write the model's files to the shared folder."""
    if order < 2:
        raise ValueError("the order is at least 2")
    spark = training.sparkSession
    address = scratch_dir(spark, "ngrams")
    folder = address.removeprefix("file://") if address.startswith("file://") else address.removeprefix("file:")
    if "://" in folder or not folder.startswith("/"):
        raise ValueError(f"workers map the model into memory: {address} must be a folder that all machines mount")
    texts = training.select("text")
    # The size sets the number of shards alone; a word takes six bytes or so.
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    shards = 1 << max(0, (size // 6 // SHARD_TOKENS).bit_length())
    word_shards = max(1, shards >> 2)  # words are fewer, and the driver sees a row of each
    words = texts.mapInArrow(_count_words(word_shards), _CHUNKS).groupBy("shard").applyInArrow(
        _word_files(folder), "shard bigint, words bigint, tokens bigint"
    )
    sizes = {row.shard: row for row in words.collect()}
    bases, total = [], 0
    for shard in range(word_shards):
        bases.append(total)
        total += sizes[shard].words if shard in sizes else 0
    tokens = sum(row.tokens for row in sizes.values())
    model = Model(folder, order, shards, tuple(bases), total, tokens, (SMALL_CORPUS,) * order, 0, 1.0)
    if not tokens:
        return model

    found = {}
    partial = None
    for level in range(order, 1, -1):
        chunks = texts.mapInArrow(_count_grams(model, level), _CHUNKS)
        if partial is not None:
            chunks = chunks.unionByName(partial.select("shard", "grams", "counts"))
        written = chunks.groupBy("shard").applyInArrow(_gram_files(model, level), f"{_CHUNKS}, of_counts array<bigint>")
        partial = stored(written, f"grams-{level}")
        found[level] = _summed(partial, 4)
    first = partial.select("shard", "grams", "counts").groupBy("shard").applyInArrow(_first_files(model), "of_counts array<bigint>")
    *found[1], more, first_total = _summed(first, 6)
    by_order = tuple(discounts(found[level]) for level in range(1, order + 1))
    d1, d2, d3 = by_order[0]
    rest = (d1 * found[1][0] + d2 * found[1][1] + d3 * more) / first_total
    return Model(folder, order, shards, tuple(bases), total, tokens, by_order, first_total, rest)


def _summed(notes: DataFrame, width: int) -> list[int]:
    row = notes.where("of_counts IS NOT NULL").agg(*(F.coalesce(F.sum(F.col("of_counts")[i]), F.lit(0)) for i in range(width))).first()
    return list(row)


# ----------------------------------------------------------------- scoring


def _discounted(counts: np.ndarray, of: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discount; 0 stays 0."""
    return counts - np.array([0.0, *of])[np.minimum(counts, 3)]


def probabilities(model: Model, store: Store, ids: np.ndarray, columns: list[np.ndarray], context: np.ndarray) -> np.ndarray:
    """Of each token after its context; ``columns`` are the ids of both."""
    p = np.full(len(ids), model.first_rest / (model.words + 1))
    if not model.first_total:
        return p
    p += _discounted(store.first_level(ids)[:, 0], model.discounts[0]) / model.first_total
    for level in range(2, model.order + 1):
        gram = columns[-level:]
        # An unknown word in the context leaves the shorter context alone.
        usable = np.flatnonzero((context >= level - 1) & np.all([c >= 0 for c in gram[:-1]], axis=0))
        before = [c[usable] for c in gram[:-1]]
        if level == 2:
            about = store.first_level(before[0])
        else:
            about = store.look_up(level - 1, gram_keys(before), np.int64, _COUNTS)[1]
        seen = about[:, 1] > 0
        usable, about = usable[seen], about[seen]
        count = np.zeros(len(usable), np.int64)
        known = ids[usable] >= 0
        kind, values = (model.count_type(), 1) if level == model.order else (np.int64, _COUNTS)
        count[known] = store.look_up(level, gram_keys([c[usable[known]] for c in gram]), kind, values)[1][:, 0]
        d = model.discounts[level - 1]
        rest = about[:, 2:] @ np.array(d)
        p[usable] = (_discounted(count, d) + rest * p[usable]) / about[:, 1]
    return p


_SCORES = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(model: Model):
    def scores(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, store = Hasher(), Store(model)
        base_of = model.tokens + model.words + 1
        for texts in arrays:
            n, known = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            base, score = np.zeros(len(texts)), np.zeros(len(texts))
            for rows, ids, occurrences, columns, context in _runs(model, texts, hasher, store):
                n += np.bincount(rows, minlength=len(texts))
                known += np.bincount(rows[occurrences > 0], minlength=len(texts))
                base += np.bincount(rows, np.log10((occurrences + 1) / base_of), len(texts))
                score += np.bincount(rows, np.log10(probabilities(model, store, ids, columns, context)), len(texts))
            yield pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip((n, known, base, score), _SCORES)], fields=list(_SCORES))

    return F.arrow_udf(scores, "struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double>", F.ArrowUDFType.SCALAR_ITER)


def score(model: Model, documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of each row of ``documents`` (doc_id, text).

    Scores are log10 probabilities of the whole text with its end; base_score is that of the
    add-one model of single tokens.
    """
    scored = documents.select("doc_id", _scored(model)("text").alias("s")).select("doc_id", "s.*")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
