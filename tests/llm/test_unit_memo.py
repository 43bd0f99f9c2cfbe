"""What the byte encoder's memo holds, it does not ask the library for again."""

from __future__ import annotations

from collections import Counter
from types import SimpleNamespace

import public_tokenizers
from tokenizers import Tokenizer

from tersely.llm import token_files

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def words(first, n):
    """Different words of letters only."""
    return ["".join(chr(97 + int(d)) for d in str(10**6 + k)) for k in range(first, first + n)]


class Counting:
    """The library's tokenizer with a model that counts what it is asked."""

    def __init__(self):
        self.library, self.model, self.asked = Tokenizer.from_file(BYTES), self, Counter()
        self.get_vocab_size = self.library.get_vocab_size
        self.get_added_tokens_decoder = self.library.get_added_tokens_decoder

    def tokenize(self, unit):
        self.asked[unit] += 1
        return [SimpleNamespace(id=1)]


def test_words_of_many_slices_are_encoded_once(monkeypatch):
    library = Counting()
    monkeypatch.setattr("tokenizers.Tokenizer", SimpleNamespace(from_file=lambda path: library))
    coder = token_files.ByteEncoder(BYTES)
    blocks = [" " + " ".join(words(k * 50_000, 50_000)) for k in range(6)]
    for block in (*range(6), 0, 1):
        assert coder.packed([blocks[block]]) == [b"\x01\x00" * 50_000]
    assert len(library.asked) == 300_000
    assert set(library.asked.values()) == {1}


def test_ids_stay_the_library_s_when_the_memo_turns_over(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_ENTRIES", 3)
    coder, library = token_files.ByteEncoder(BYTES), Tokenizer.from_file(BYTES)
    texts = ["one two  three!? 1,234\n\n vier fünf", "", "日本 one\ttwo ...", "five <|endoftext|> six", "vier  ", "one two"]
    for _ in range(3):
        for text in texts:
            ids = library.encode(text, add_special_tokens=False).ids
            assert coder.packed([text, text]) == 2 * [b"".join(i.to_bytes(2, "little") for i in ids)]
            assert len(coder.memo) < 20
