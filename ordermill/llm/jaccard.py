"""N-gram Jaccard join with a token-group matrix.

Texts are sets of word shingles. Documents with equal sets are one class, and one
representative of each class goes on. The join then works on groups:

1. Partition: each representative has a few min-hash marks. It is compared with one
   leader per mark, the text with the smallest share of rare tokens; links found here join
   them already. Its group is that of its most frequent mark; large groups are split.
2. Matrix: for each group, the tokens of its members' prefixes, one row per token and
   group, and the union of all its members' tokens. Under one order of all tokens, two
   sets that link share at least ceil(0.03 * n) tokens of their prefixes of
   n - ceil(t * n) + ceil(0.03 * n) tokens, n the set's size and t the threshold.
3. Bound: a query document meets the groups that share its prefix tokens, whose sizes
   allow a link and that hold members of other components. Its overlap with the group's whole union
   bounds its overlap with any member; groups below the need stay closed.
4. Open: the members of qualifying groups are compared with the query, first by bitmaps of their
   tokens, which bound the overlap of a pair, then exactly on the whole texts, unless
   links have joined them before. Of two components, members of the smaller one ask.

The token order puts tokens that many texts share last, so that common passages do not
join their texts. Its counts are hashed into ``1 << COUNT_BITS`` counters over all texts; tasks report
the counters above their mean. The order affects cost only, never the result.

Rows with one doc_id are one document for the components. Rows without doc_id or words
link with nothing. Repeated rows each give a row. Columns other than doc_id and text are left out by
``similar_documents`` and kept by ``drop_near_duplicates``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ordermill.llm.bloom import bloom_filter, with_possible
from ordermill.llm.components import components
from ordermill.llm.spans import LOWER, WHITE, Block, Hasher, blocks, mixed, word_places
from ordermill.llm.stored import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNT_BITS = 20
COMMON = 1 << 16  # counters kept for the token order at most
MARKS = 8
RESERVE = 0.03
# A group has about as many members and tokens at most.
GROUP_MEMBERS = 64
GROUP_TOKENS = 1 << 20
# Tokens are also hashed to a bitmap per document, for a bound on single pairs.
BITMAP_BITS = 10

_PROFILE = "n bigint, rare double, print string, prefix array<bigint>, marks array<bigint>, bits array<bigint>"


def needed(size, percent: int):
    """Smallest overlap that a set of this size needs for a link: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


def reserve(size):
    return -(-size * 3 // 100)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of all runs of ``width`` words; of fewer words, the one run there is."""
    if not len(words):
        return words
    run = min(width, len(words))
    total = np.full(len(words) - run + 1, np.uint64(run))
    for i in range(run):
        total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - run + 1 + i])
    return np.unique(total)


def shingle_sets(texts: pa.Array, hasher: Hasher, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch, one text at a time."""
    parts: list[np.ndarray] = []  # the words so far of a text longer than a block
    row = -1
    for block in blocks(texts, WHITE):
        if parts and (block.whole or block.rows[0] != row):
            yield _shingles(np.concatenate(parts), width)
            parts = []
        words, ends = _words(block, hasher)
        if block.whole:
            for start, end in zip(ends, ends[1:]):
                yield _shingles(words[start:end], width)
        else:
            row = int(block.rows[0])
            parts.append(words)
    if parts:
        yield _shingles(np.concatenate(parts), width)


def _words(block: Block, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_places(block, ~WHITE)
    words = mixed(hasher.runs(hasher.sums(LOWER[block.data]), starts, ends))
    return words, np.searchsorted(starts, block.bounds)


def _counted(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, totals = Hasher(), np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            gathered, size = [], 0
            for tokens in shingle_sets(batch.column(0), hasher, width):
                gathered.append(tokens)
                size += len(tokens)
                if size > 1 << 20:
                    totals += _spread(gathered)
                    gathered, size = [], 0
            if gathered:
                totals += _spread(gathered)
        common = np.flatnonzero(totals >= 4 + 4 * totals.mean())
        yield pa.RecordBatch.from_arrays([pa.array(common, pa.int64()), pa.array(totals[common])], ["counter", "times"])

    return count


def _spread(sets: list[np.ndarray]) -> np.ndarray:
    places = (np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
    return np.bincount(places, minlength=1 << COUNT_BITS)


def _common_counters(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters of frequent tokens, ``COMMON`` at most, with their counts."""
    counted = texts.mapInArrow(_counted(width), "counter bigint, times bigint")
    rows = (
        counted.groupBy("counter").agg(F.sum("times").alias("times"))
        .orderBy(F.col("times").desc(), "counter").limit(COMMON).collect()
    )
    return np.array([r.counter for r in rows], np.int64), np.array([r.times for r in rows], np.int64)


def _profiles(width: int, percent: int, counters: np.ndarray, times: np.ndarray):
    def profiled(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = Hasher()
        load = np.zeros(1 << COUNT_BITS, np.int64)
        load[counters] = times
        salts = mixed(np.arange(1, MARKS + 1, dtype=np.uint64))
        for texts in arrays:
            sizes, shares, prints, prefixes, marks, bits = [], [], [], [], [], []
            for tokens in shingle_sets(texts, hasher, width):
                n = len(tokens)
                sizes.append(n)
                prints.append(xxhash.xxh3_128_hexdigest(tokens.tobytes()) if n else None)
                loads = load[(tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                taken = min(n, n - needed(n, percent) + reserve(n))
                prefixes.append(tokens[np.argsort(loads, kind="stable")[:taken]].view(np.int64))
                shares.append(float((loads == 0).mean()) if n else None)
                marks.append(
                    np.array([mixed(tokens ^ s).min() ^ s for s in salts], np.uint64).view(np.int64) if n else np.zeros(0, np.int64)
                )
                held = np.zeros(1 << BITMAP_BITS, bool)
                held[tokens >> np.uint64(64 - BITMAP_BITS)] = True
                bits.append(np.packbits(held).view(np.int64))
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(shares, pa.float64()), pa.array(prints, pa.string()), _lists(prefixes), _lists(marks), _lists(bits)],
                ["n", "rare", "print", "prefix", "marks", "bits"],
            )

    return F.arrow_udf(profiled, f"struct<{_PROFILE.replace(' ', ':').replace(',:', ',')}>", F.ArrowUDFType.SCALAR_ITER)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))


def _linked(width: int, percent: int):
    def compare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hasher = Hasher()
        for left, right in batches:
            verdicts = []
            for a, b in zip(shingle_sets(left, hasher, width), shingle_sets(right, hasher, width)):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                verdicts.append(bool(shared) and 100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.array(verdicts, pa.bool_())

    return F.arrow_udf(compare, "boolean", F.ArrowUDFType.SCALAR_ITER)


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _bitmaps_allow(n: str, bits: str, other_n: str, other_bits: str, percent: int) -> Column:
    """Each bit that one bitmap has and the other lacks stands for a token or more not shared."""

    def most_shared(size: str, own: str, other: str) -> Column:
        lacking = F.zip_with(own, other, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b))))
        return F.col(size) - F.aggregate(lacking, F.lit(0), lambda total, x: total + x)

    overlap = F.least(most_shared(n, bits, other_bits), most_shared(other_n, other_bits, bits))
    return overlap * 100 >= (F.col(n) + F.col(other_n) - overlap) * percent


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of representatives whose whole texts link."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    kept = with_possible(texts, "doc_id", bloom_filter(asked, "id", at_most=2 * pairs.count()), "_llm_asked").where("_llm_asked")
    one = kept.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    other = kept.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(other, "b")
    return both.where(_linked(width, percent)("text_a", "text_b")).select("a", "b").distinct()


def _unions(width: int):
    def union(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Of the texts of one group each: the tokens, and which of them several members have."""
        hasher = Hasher()
        for groups in arrays:
            tokens, several = [], []
            for group in groups:
                listed, counts = np.unique(np.concatenate(list(shingle_sets(group.values, hasher, width))), return_counts=True)
                tokens.append(listed.view(np.int64))
                several.append(listed[counts > 1].view(np.int64))
            yield pa.StructArray.from_arrays([_lists(tokens), _lists(several)], ["tokens", "several"])

    return F.arrow_udf(union, "struct<tokens:array<bigint>,several:array<bigint>>", F.ArrowUDFType.SCALAR_ITER)


def _reaches(width: int, percent: int):
    def bound(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        """Whether a text's overlap with a union is enough for a link with a member of ``least_n`` tokens or more."""
        hasher = Hasher()
        for texts, tokens, several, own, least_n in batches:
            verdicts = []
            for own_tokens, group, shared, is_own, least in zip(shingle_sets(texts, hasher, width), tokens, several, own, least_n):
                # In its own group a document does not count for itself.
                union = (shared if is_own.as_py() else group).values.to_numpy(zero_copy_only=False).view(np.uint64)
                overlap = len(np.intersect1d(own_tokens, union, assume_unique=True))
                size = max(least.as_py(), needed(len(own_tokens), percent), overlap)
                verdicts.append(100 * overlap >= percent * (len(own_tokens) + size - overlap))
            yield pa.array(verdicts, pa.bool_())

    return F.arrow_udf(bound, "boolean", F.ArrowUDFType.SCALAR_ITER)


def _qualifying(meeting: DataFrame, grouped: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (doc_id, other) whose document reaches the need with the whole union of the group ``other``."""
    asked = meeting.select(F.col("other").alias("group")).distinct()
    members = grouped.select("doc_id", "n", "group").join(asked, "group", "left_semi")
    ids = stored(members.select("doc_id").union(meeting.select("doc_id")).distinct(), "asked")
    kept = with_possible(texts, "doc_id", bloom_filter(ids, "doc_id"), "_llm_asked").where("_llm_asked").select("doc_id", "text")
    # Groups are split, so that one holds GROUP_MEMBERS texts or GROUP_TOKENS tokens, or about as many.
    unions = members.join(kept, "doc_id").groupBy("group").agg(
        F.collect_list("text").alias("texts"), F.min("n").alias("least_n")
    ).select(F.col("group").alias("other"), "least_n", _unions(width)("texts").alias("u"))
    unions = stored(unions, "unions")
    asking = meeting.join(kept, "doc_id").join(grouped.select("doc_id", F.col("group").alias("own")), "doc_id")
    bounded = asking.join(unions, "other").where(
        _reaches(width, percent)("text", "u.tokens", "u.several", F.col("own") == F.col("other"), "least_n")
    )
    return stored(bounded.select("doc_id", "other").distinct(), "qualifying")


def similar_documents(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Each row's doc_id, n_shingles and component_id.

    ``documents`` needs doc_id and text; two documents link when their shingle sets of
    ``width`` words overlap by ``percent`` of their union or more. component_id is the smallest
    doc_id reachable over links, its own included; null where doc_id is null.
    """
    texts = documents.select("doc_id", "text")
    common = _common_counters(texts.select("text"), width)
    profile = texts.select("doc_id", _profiles(width, percent, *common)("text").alias("p")).select("doc_id", "p.*")
    profile = stored(profile, "profiles")

    known = profile.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("print").agg(F.min("doc_id").alias("low"))
    of_class = known.select("doc_id", "print").join(classes, "print").where("doc_id <> low")
    copies = stored(of_class.select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct(), "copies")
    # A copy goes no further: its smallest fellow stands for it. A doc_id that repeats
    # with different texts stays with each of them.
    repeated = known.groupBy("doc_id").agg(F.countDistinct("print").alias("kinds")).where("kinds > 1")
    lesser = copies.join(repeated, copies.a == repeated.doc_id, "left_anti").select(F.col("a").alias("doc_id"))
    heads = stored(known.join(lesser, "doc_id", "left_anti").dropDuplicates(["doc_id", "print"]), "heads")

    marked = heads.select("doc_id", "n", "rare", F.explode("marks").alias("mark"))
    # The fewest rare tokens: the text that the others of its mark were edited from, if it is there.
    leaders = marked.groupBy("mark").agg(
        F.min(F.struct("rare", "doc_id", "n")).alias("leader"), F.count("*").alias("holders"), F.sum("n").alias("tokens")
    ).where("holders > 1").select(
        "mark", F.col("leader.doc_id").alias("leader"), F.col("leader.n").alias("leader_n"), "holders",
        F.ceil(F.greatest(F.col("holders") / GROUP_MEMBERS, F.col("tokens") / GROUP_TOKENS)).alias("parts"),
    )
    led = stored(marked.join(leaders, "mark"), "led")
    near = (
        led.where((F.col("doc_id") != F.col("leader")) & _sizes_allow("n", "leader_n", percent))
        .select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    )
    first_links = stored(_verified(near, texts, width, percent), "first-links")

    joined = stored(components(first_links), "joined")
    sizes = joined.groupBy("component").agg(F.count("*").alias("members"))
    joined = joined.join(sizes, "component").select("node", F.struct("members", "component").alias("set"))
    split = F.xxhash64("mark", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    groups = led.select("doc_id", F.struct("holders", "mark", split.alias("group")).alias("g"))
    groups = groups.groupBy(F.col("doc_id").alias("_grouped")).agg(F.max("g").alias("g"))
    alone = F.struct(F.lit(1).cast("bigint").alias("members"), F.col("doc_id").alias("component"))
    grouped = heads.join(joined, heads.doc_id == joined.node, "left").join(groups, F.col("doc_id") == F.col("_grouped"), "left")
    grouped = stored(
        grouped.select(
            "doc_id", "n", F.coalesce("set", alone).alias("set"), F.coalesce("g.group", F.xxhash64("doc_id", F.lit("alone"))).alias("group"),
            "prefix", "bits",
        ),
        "grouped",
    )

    tokens = grouped.select("doc_id", "n", "set", "group", F.explode("prefix").alias("token"))
    # Tokens of a single component open nothing.
    shared = tokens.groupBy("token").agg(F.min("set.component").alias("low"), F.max("set.component").alias("high"))
    queries = stored(tokens.join(shared.where("low <> high").select("token"), "token", "left_semi"), "shared-tokens")
    matrix = queries.groupBy("token", F.col("group").alias("other")).agg(
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("set").alias("most_set")
    )
    bound = F.least(F.ceil(F.min("n") * RESERVE), F.ceil(F.min("least_n") * RESERVE))
    meeting = (
        queries.join(matrix, "token").where(F.col("set") < F.col("most_set"))
        .where((F.col("most_n") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least_n") * percent))
        .groupBy("doc_id", "other").agg(F.count("*").alias("overlap"), bound.alias("bound"))
        .where("overlap >= bound").select("doc_id", "other")
    )
    qualifying = _qualifying(stored(meeting, "meeting"), grouped, texts, width, percent)
    members = grouped.select(
        F.col("doc_id").alias("member"), F.col("n").alias("member_n"), F.col("set").alias("member_set"), F.col("bits").alias("member_bits"), "group"
    )
    asking = qualifying.join(grouped.select("doc_id", "n", "set", "bits"), "doc_id")
    opened = (
        asking.join(members, F.col("other") == F.col("group"))
        .where((F.col("set") < F.col("member_set")) & _sizes_allow("n", "member_n", percent))
        .where(_bitmaps_allow("n", "bits", "member_n", "member_bits", percent))
        .select(F.least("doc_id", "member").alias("a"), F.greatest("doc_id", "member").alias("b"))
    )
    second_links = _verified(opened, texts, width, percent)
    found = stored(components(copies.union(first_links).union(second_links)), "components")
    result = profile.join(found, profile.doc_id == found.node, "left")
    return result.select(
        profile.doc_id, F.col("n").alias("n_shingles"), F.coalesce("component", profile.doc_id).alias("component_id")
    )


def drop_near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Keep of each component of similar documents the row with the smallest doc_id.

    Of rows that repeat a doc_id and its text one stays. Rows without words stay.
    Columns are those given. Only the rows that a Bloom filter picks are shuffled.
    """
    sizes = similar_documents(documents, width, percent)
    losers = sizes.where("component_id <> doc_id").select(F.col("doc_id").alias("_llm_loser")).distinct()
    twice = documents.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_llm_loser")).count().where("count > 1")
    losers = stored(losers, "losers")
    suspects = losers.union(stored(twice.select("_llm_loser"), "repeats"))
    asked = with_possible(documents, "doc_id", bloom_filter(suspects, "_llm_loser"), "_llm_suspect")
    clear = asked.where(~F.col("_llm_suspect")).drop("_llm_suspect")
    careful = asked.where("_llm_suspect").drop("_llm_suspect")
    stays = careful.join(losers, careful.doc_id == losers._llm_loser, "left_anti").dropDuplicates(["doc_id", "text"])
    return clear.unionByName(stays.select(*clear.columns))
