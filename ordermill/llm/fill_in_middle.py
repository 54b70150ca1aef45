"""Fill-in-the-middle transformation of texts.

A text is cut into n units: white space with the word after it, or white space at the end. One
``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of the group, so
``match.ends(1)`` gives n and the place of each cut without a loop. All quantifiers are
possessive: the match never backs off, and its time and memory grow with the text alone.

Cuts and form follow from the id and a seed, not from chance: h1 to h4 are the first four groups of
eight hexadecimal digits of sha256("seed:id"). The prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) units, the middle after the larger. Where h3 % 100 is below ``fim_percent`` the text is
rearranged, in the order suffix, prefix, middle (spm) where h4 % 100 is below ``spm_percent``, else
prefix, suffix, middle (psm).

Null and empty texts, and texts that hold one of the marks, stay as they are (plain); a null text becomes an
empty one. A null id counts as an empty string, so repeated rows and rows without id with equal
texts have equal results. Columns of the input other than doc_id and text are left out, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: repeated units, over code points.
UNITS = r"((?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++))*+"

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Settings:
    """Marks must not overlap one another, so that a text without them is read back in one way only."""

    seed: str = "42"
    fim_percent: int = 50
    spm_percent: int = 80
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix_mark, self.suffix_mark, self.middle_mark)
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("three different marks are needed")
        for a in marks:
            for b in marks:
                shared = any(a.endswith(b[:i]) for i in range(1, len(b)))
                if shared or (a != b and a in b):
                    raise ValueError(f"the marks {a!r} and {b!r} overlap")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark


def rearranged(doc_id: str, text: str, settings: Settings, units: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """n, form, characters of prefix and middle (None if plain), and the output of one text."""
    ends = units.fullmatch(text).ends(1)
    n = len(ends)
    digest = sha256(f"{settings.seed}:{doc_id}".encode()).hexdigest()
    first, second, third, fourth = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not n or third % 100 >= settings.fim_percent or any(mark in text for mark in settings.marks):
        return n, PLAIN, None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ends[low - 1] if low else 0), (ends[high - 1] if high else 0)
    pre, suf, mid = settings.marks
    if fourth % 100 < settings.spm_percent:
        return n, SPM, a, b - a, f"{suf}{text[b:]}{pre}{text[:a]}{mid}{text[a:b]}"
    return n, PSM, a, b - a, f"{pre}{text[:a]}{suf}{text[b:]}{mid}{text[a:b]}"


_TYPE = pa.struct(
    [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)


def _transform(settings: Settings):
    def transformed(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        units = regex.compile(UNITS)
        for ids, texts in arrays:
            rows = [rearranged(i.as_py() or "", t.as_py() or "", settings, units) for i, t in zip(ids, texts)]
            columns = zip(*rows) if rows else [()] * len(_TYPE)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TYPE)], fields=list(_TYPE))

    return F.arrow_udf(
        transformed, "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>", F.ArrowUDFType.SCALAR_ITER
    )


def fill_in_middle(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of ``documents`` (doc_id, text)."""
    # A null id counts as ''.
    given = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return documents.select("doc_id", _transform(settings)(given, F.col("text")).alias("t")).select("doc_id", "t.*")


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that an output was made from."""
    quoted = "|".join(rf"\Q{mark}\E" for mark in settings.marks)
    parts = F.split(output, quoted, 4)
    return (
        F.when(form == PSM, F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == SPM, F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(output)
    )
