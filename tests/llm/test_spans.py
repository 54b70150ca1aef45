import re

import numpy as np
import pyarrow as pa

from ordermill.llm.spans import CHARACTER, LOWER, WHITE, Hasher, blocks, part_of, word_places

TEXTS = ["Some words  here", None, "", "ünï\tcödé", " x ", "a b c d e f g h", "longlonglonglonglong word"]


def words_of(texts, limit):
    hasher, found = Hasher(), {}
    for block in blocks(pa.array(texts, pa.string()), WHITE, limit=limit):
        starts, ends = word_places(block, ~WHITE)
        data = LOWER[block.data]
        hashes = hasher.runs(hasher.sums(data), starts, ends)
        for start, end, part, value in zip(starts, ends, part_of(block, starts), hashes):
            found.setdefault(int(block.rows[part]), []).append((bytes(data[start:end]).decode(), int(value)))
    return found


def test_words_are_whole_whatever_the_block():
    whole = words_of(TEXTS, 1 << 20)
    for row, text in enumerate(TEXTS):
        plain = "".join(c.lower() if c.isascii() else c for c in text or "")
        assert [w for w, _ in whole.get(row, [])] == re.findall(r"[^ \t]+", plain)
    for limit in (1, 3, 7, 16):
        assert words_of(TEXTS, limit) == whole


def test_equal_words_have_equal_hashes_and_others_do_not():
    pairs = {p for listed in words_of([" ".join(f"w{i}" for i in range(5000))] * 2, 1 << 12).values() for p in listed}
    assert len(pairs) == len({v for _, v in pairs}) == 5000


def test_overlap_starts_at_a_character():
    text = "äöü€😀" * 20
    parts = list(blocks(pa.array([text]), CHARACTER, overlap=12, limit=16))
    assert all(bytes(p.data).decode() for p in parts)
    joined = np.concatenate([p.data for p in parts])
    assert len(joined) > len(text.encode())


def test_slices_of_arrow_arrays():
    array = pa.array(["skip", "one two", None, "three"])[1:]
    found = [bytes(b.data).decode() for b in blocks(array, WHITE)]
    assert found == ["one twothree"]
