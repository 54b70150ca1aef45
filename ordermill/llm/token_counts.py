"""Token counts of texts from the piece counts of their distinct pre-tokens.

The pieces of a byte-level BPE never cross the borders of its pre-tokens, so a text
has as many tokens as its pre-tokens have pieces. One pass finds the distinct
pre-tokens and how often each occurs; the tokenizer then counts the pieces of each
once. A second pass takes the pre-token frequencies of each text and joins them with
the counts: the ``head`` most frequent pre-tokens are a bounded table that every task
gets, all others are joined by shuffle. No token ids are kept.

Only byte-level BPE files are taken whose pre-tokens are those of ``PRE_TOKENS`` (``check_covered``); any other is refused. Null
and empty texts have no tokens. Columns other than doc_id and text are left out, whatever their names. Special strings of the tokenizer inside a text are
one token each, as the library treats them by default.
"""

from __future__ import annotations

import json
import os
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ordermill.llm.stored import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the pre-token pattern of the byte-level tokenizers.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

HEAD = 1 << 18
_FLUSH = 1 << 18  # distinct pre-tokens that a task holds before it passes them on


def pre_tokens(specials: list[str]):
    """A function from a text to its pre-tokens; special strings are left out of them."""
    find = regex.compile(PRE_TOKENS).findall
    if not specials:
        return lambda text: (find(text), 0)
    first = [s[:2] for s in specials]
    split = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))).split

    def cut(text: str) -> tuple[list[str], int]:
        if not any(s in text for s in first):
            return find(text), 0
        parts = split(text)
        return list(chain.from_iterable(map(find, parts))), len(parts) - 1

    return cut


def _load(path: str):
    # One thread per task: Spark runs the tasks side by side.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class NotCovered(ValueError):
    """Raised for a tokenizer file whose tokens are not those that this module would count."""


def check_covered(path: str) -> None:
    """Refuse a file unless its pieces stay inside the pre-tokens of ``PRE_TOKENS``."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    refused = {
        "a normaliser": spec.get("normalizer") is not None,
        "a model that is no BPE": model.get("type", "BPE") != "BPE",
        "dropout": bool(model.get("dropout")),
        "marks inside or at the end of words": bool(model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
        "a pre-tokenizer other than byte-level": split.get("type") != "ByteLevel",
        "a pre-tokenizer without the pattern": not split.get("use_regex", True),
        "a blank before the text": bool(split.get("add_prefix_space", True)),
        "truncation or padding": bool(spec.get("truncation") or spec.get("padding")),
        "special strings that take blanks or words with them": any(
            token.get("lstrip") or token.get("rstrip") or token.get("single_word") for token in spec.get("added_tokens") or ()
        ),
    }
    if found := [what for what, held in refused.items() if held]:
        raise NotCovered(f"{path} has {', '.join(found)}")


def special_strings(path: str) -> list[str]:
    """The strings that the tokenizer takes out of a text before all else."""
    return [token.content for token in _load(path).get_added_tokens_decoder().values()]


def _vocabulary(specials: list[str]):
    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = pre_tokens(specials), Counter()

        def out() -> pa.RecordBatch:
            words, times = list(seen.keys()), list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], ["word", "times"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(cut(text.as_py() or "")[0])
                if len(seen) > _FLUSH:
                    yield out()
        yield out()

    return occurring


def _pieces(path: str):
    def counted(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _load(path)
        for words in arrays:
            listed, counts = words.to_pylist(), []
            for i in range(0, len(listed), 1024):
                encoded = tokenizer.encode_batch_fast(listed[i : i + 1024], add_special_tokens=False)
                counts += [len(e) for e in encoded]
            yield pa.array(counts, pa.int64())

    return F.arrow_udf(counted, "bigint", F.ArrowUDFType.SCALAR_ITER)


def _frequencies(specials: list[str], head):
    """Of each text: its bytes, the tokens of its special strings and of ``head`` words, the other words."""

    def listed(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut, pieces_of = pre_tokens(specials), head.value.get
        for texts in arrays:
            sizes, totals, ends, words, counts = [], [], [0], [], []
            for value in texts:
                text = value.as_py() or ""
                found, known = cut(text)
                for word, times in Counter(found).items():
                    pieces = pieces_of(word)
                    if pieces is None:
                        words.append(word)
                        counts.append(times)
                    else:
                        known += pieces * times
                sizes.append(len(text.encode()))
                totals.append(known)
                ends.append(len(words))
            rest = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "times"])
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)],
                ["n_bytes", "known", "rest"],
            )

    return F.arrow_udf(
        listed, "struct<n_bytes:bigint,known:bigint,rest:array<struct<word:string,times:bigint>>>", F.ArrowUDFType.SCALAR_ITER
    )


def count_tokens(documents: DataFrame, tokenizer_path: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of ``documents`` (doc_id, text).

    ``tokenizer_path`` names a byte-level BPE file that every executor has. Rows that
    repeat a doc_id are counted each for itself.
    """
    check_covered(tokenizer_path)
    specials = special_strings(tokenizer_path)
    texts = documents.select("doc_id", "text")
    words = texts.select("text").mapInArrow(_vocabulary(specials), "word string, times bigint")
    words = words.groupBy("word").agg(F.sum("times").alias("times"))
    counted = stored(words.select("word", "times", _pieces(tokenizer_path)("word").alias("pieces")), "vocabulary")
    # Bounded by ``head`` rows; every other word goes the way of the join below.
    common = counted.orderBy(F.col("times").desc(), "word").limit(head)
    known = {row.word: row.pieces for row in common.select("word", "pieces").toLocalIterator()}
    shared = documents.sparkSession.sparkContext.broadcast(known)

    measured = texts.select("doc_id", _frequencies(specials, shared)("text").alias("t"))
    measured = stored(measured.select(F.expr("uuid()").alias("row"), "doc_id", "t.*"), "frequencies")
    rest = measured.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    joined = rest.join(counted.select("word", "pieces"), "word")
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    return measured.join(sums, "row", "left").select(
        "doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    )
