"""Fingerprints of texts as multisets of paragraphs.

Each paragraph (line) is hashed to a vector of ``LANES`` lanes modulo 2^16 in which a few
lanes, chosen by the hash, are not zero. A text's fingerprint is the sum of its
paragraphs' vectors: order does not matter, and a paragraph is added or taken away by
adding or subtracting its vector. Equal multisets have equal fingerprints; the lanes on
which two fingerprints agree tell how many paragraphs they share. SQL functions throughout.

An empty or null text has the zero fingerprint. Long texts are hashed whole, paragraph by paragraph. Repeated rows
give a row each, rows without id come last in the order of ids; columns other than doc_id and text are left out, whatever
their names, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ordermill.llm.stored import stored

LANES = 128
TOUCHED = 4  # lanes that one paragraph adds to
_GROUP = 16
_MODULUS = 1 << 16


def _contributions(text: Column) -> Column:
    """The lane * 2^16 + value of each touched lane of each paragraph, from its sha-256."""

    def touched(digest: Column) -> list[Column]:
        # Each lane takes 7 bits of one hex number and 16 bits of another.
        return [
            F.conv(F.substring(digest, 16 * i + 1, 2), 16, 10).cast("long") % LANES * _MODULUS
            + F.conv(F.substring(digest, 16 * i + 3, 4), 16, 10).cast("long")
            for i in range(TOUCHED)
        ]

    return _of_paragraphs(text, touched)


def _signs(text: Column) -> Column:
    """As ``_contributions``, with +1 or -1 (modulo 2^16) as values, from other hex numbers of the sha-256."""

    def touched(digest: Column) -> list[Column]:
        drawn = [F.conv(F.substring(digest, 16 * i + 7, 2), 16, 10).cast("long") for i in range(TOUCHED)]
        return [x % LANES * _MODULUS + F.when(x < LANES, F.lit(1)).otherwise(F.lit(_MODULUS - 1)) for x in drawn]

    return _of_paragraphs(text, touched)


def _of_paragraphs(text: Column, touched: Callable[[Column], list[Column]]) -> Column:
    lines = F.when(text != "", F.split(text, "\n")).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(lines, lambda line: F.array(*touched(F.sha2(line, 256)))))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as an array of ``LANES`` numbers below 2^16."""
    return _lanes(_contributions(F.coalesce(text, F.lit(""))))


def sketch(text: Column) -> Column:
    """The sketch of a text for ``shared``: like a fingerprint, ``plus`` and ``minus`` included."""
    return _lanes(_signs(F.coalesce(text, F.lit(""))))


def _lanes(contributions: Column) -> Column:
    """Sums by lane, modulo 2^16."""

    def lanes_of(group: Column, listed: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(_GROUP - 1)),
            lambda lane: F.aggregate(
                listed,
                F.lit(0).cast("long"),
                lambda total, x: total
                + F.when(F.floor(x / _MODULUS) == group * _GROUP + lane, x % _MODULUS).otherwise(F.lit(0)),
                lambda total: total % _MODULUS,
            ),
        )

    # Contributions are first narrowed to a group of lanes, then summed lane by lane.
    def summed(listed: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit(LANES // _GROUP - 1)),
                lambda group: F.element_at(
                    F.transform(
                        F.array(F.filter(listed, lambda x: F.floor(x / (_MODULUS * _GROUP)) == group)),
                        lambda narrowed: lanes_of(group, narrowed),
                    ),
                    1,
                ),
            )
        )

    return F.element_at(F.transform(F.array(contributions), summed), 1)


def plus(one: Column, other: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.zip_with(one, other, lambda a, b: (a + b) % _MODULUS)


def minus(one: Column, other: Column) -> Column:
    """The fingerprint of the first multiset without the paragraphs of the other."""
    return F.zip_with(one, other, lambda a, b: (a - b + _MODULUS) % _MODULUS)


def as_text(lanes: Column) -> Column:
    """Four lower-case hex digits per lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def likeness(one: Column, other: Column) -> Column:
    """Of the lanes that either uses, the share on which both agree; 1.0 for two empty texts."""
    pairs = F.arrays_zip(one.alias("a"), other.alias("b"))
    used = F.size(F.filter(pairs, lambda p: (p["a"] != 0) | (p["b"] != 0)))
    equal = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != 0)))
    return F.when(used == 0, F.lit(1.0)).otherwise(equal / used)


def shared(one: Column, other: Column) -> Column:
    """The shared share of the paragraphs of two sketched texts: sums of lesser counts over sums of greater ones.

    The squares of a sketch's lanes add up to about ``TOUCHED`` times its number of paragraphs,
    those of a difference to the paragraphs only one has. Exact for equal multisets; otherwise an
    estimate whose error does not grow with the length, as long as few paragraphs repeat in a text.
    1.0 for two empty texts.
    """

    def squares(lanes: Column) -> Column:
        signed = F.transform(lanes, lambda x: F.when(x < _MODULUS // 2, x).otherwise(x - _MODULUS))
        return F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x * x).cast("double")

    both, apart = squares(one) + squares(other), squares(minus(one, other))
    return F.when(both + apart == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (both - apart) / (both + apart)))


def following(documents: DataFrame) -> DataFrame:
    """(key, next_key, n_chars) of the distinct documents in descending doc_id, as a ring.

    ``documents`` has key, doc_id and n_chars. Only these go through the range shuffle; the
    border of a run of rows is one row. Null ids come last, ties follow the key.
    """
    placed = (
        documents.select("doc_id", "key", "n_chars").distinct()
        .repartitionByRange(F.col("doc_id").desc_nulls_last(), "key").withColumn("run", F.spark_partition_id())
    )
    placed = stored(placed, "order")
    order = F.col("doc_id").desc_nulls_last(), F.col("key")
    inside = Window.partitionBy("run").orderBy(*order)
    numbered = placed.select("*", F.lead("key").over(inside).alias("inner_next"))
    # One row per run, so no more than there are partitions.
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))
    tops = placed.groupBy("run").agg(F.max(first).alias("top")).select(F.col("run").alias("_run"), F.col("top.id").alias("_top"))
    at_top = placed.join(F.broadcast(tops), (F.col("run") == F.col("_run")) & F.col("doc_id").eqNullSafe(F.col("_top")))
    heads = at_top.groupBy("run").agg(F.min("key").alias("head"))
    ring = Window.orderBy("run")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = heads.select(
        F.col("run").alias("_run"), F.coalesce(F.lead("head").over(ring), F.first("head").over(whole)).alias("outer_next")
    )
    linked = numbered.join(F.broadcast(borders), F.col("run") == F.col("_run"))
    return linked.select("key", F.coalesce("inner_next", "outer_next").alias("next_key"), "n_chars")


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``documents`` (doc_id, text), of its edited text and likenesses.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of
    the next document's text, in descending doc_id. Rows with the same doc_id and
    text are one document in that order, and each gets the same result.
    """
    text = F.coalesce("text", F.lit(""))
    base = documents.select("doc_id", text.alias("text"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))
    keyed = base.select("doc_id", "text", key.alias("key"), F.length("text").cast("long").alias("n_chars"))
    links = stored(following(keyed), "following")

    # Both joins read the same columns by the same key, so that texts are shuffled once for both.
    wanted = links.select(F.col("key").alias("to"), F.col("next_key"), F.col("n_chars").alias("to_chars"))
    sent = keyed.join(wanted, F.col("key") == F.col("next_key"))
    cut = F.expr("substring(text, 1, CAST(least(n_chars, floor(to_chars / 3)) AS INT))")
    pieces = sent.select("to", F.struct(cut.alias("piece"), fingerprint(F.col("text")).alias("lanes"), F.col("doc_id").alias("id")).alias("next"))
    pieces = pieces.groupBy("to").agg(F.first("next").alias("next"))
    joined = keyed.join(pieces, F.col("key") == F.col("to"))
    edited = F.concat(F.expr("substring(text, 1, CAST(n_chars - floor(n_chars / 3) AS INT))"), F.col("next.piece"))
    both = joined.select("doc_id", "n_chars", "text", edited.alias("edited"), "next").select(
        "doc_id", "n_chars", F.col("next.id").alias("next_id"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("lanes"), fingerprint(F.col("edited")).alias("edited_lanes"), F.col("next.lanes").alias("next_lanes"),
    )
    return both.select(
        "doc_id", "n_chars", "next_id", "edited_sha256",
        as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
