import json

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ordermill.llm import token_counts
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = ODD + [
    (20, "it's we'll  spaces   and\n\n lines\t\ttabs 123 4567 mixed1 !!! ...\r\n"),
    (21, "a<|endoftext|>b<|endoftext|> <|endof"),
    (22, "naïve “quotes” — 日本語テキスト 🙂🙂    end"),
    (23, "the the the cat cat sat " * 30_000),
    (24, "x" * 3000),
    (25, "   "),
    (26, "'s 't''re I'LL we'ré ①②"),
]


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_equals_the_library(documents, head):
    library = Tokenizer.from_file(PATH)
    got = token_counts.count_tokens(documents(ROWS), PATH, head or 1)
    expected = sorted(
        ((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in ROWS), key=repr
    )
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()), key=repr) == expected


def test_empty_table(documents):
    assert token_counts.count_tokens(documents([]), PATH).collect() == []


@pytest.mark.parametrize("change, said", [
    ({"normalizer": {"type": "Lowercase"}}, "normaliser"), ({"pre_tokenizer": {"type": "Whitespace"}}, "byte-level"), ({"pre_tokenizer": None}, "byte-level"),
    ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, "blank before"),
    ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}}, "without the pattern"),
    ({"model": {"type": "WordPiece"}}, "no BPE"), ({"model": {"type": "BPE", "dropout": 0.1}}, "dropout"),
    ({"added_tokens": [{"content": "<x>", "lstrip": True}]}, "special strings"), ({"truncation": {"max_length": 8}}, "truncation"),
])
def test_other_tokenizers_are_refused(documents, tmp_path, change, said):
    given = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"type": "BPE"}, "added_tokens": []}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(given | change))
    with pytest.raises(token_counts.NotCovered, match=said):
        token_counts.check_covered(str(path))
    path.write_text(json.dumps(given))
    token_counts.check_covered(str(path))


def test_the_file_of_words_is_refused(documents):
    with pytest.raises(token_counts.NotCovered):
        token_counts.count_tokens(documents(ROWS), public_tokenizers.path("word_bpe_49k.json"))
