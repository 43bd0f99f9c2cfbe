"""BPE encoding and decoding with an index of pair occurrences.

The texts of a partition are normalised and split into words by the vocabulary's own
rules. All new words of a slice of texts are then merged together: an index maps every
adjacent pair that has a rank to all its positions in the slice, a heap holds the ranks
that occur, and ranks are applied in ascending order, each to its whole list from left
to right. A merge takes the pair's two neighbours out of reach and puts two new pairs
into the lists of their own ranks. Stale positions are seen by comparing symbols.

Where a merge makes a pair of lower rank, the rest of its list goes back and waits, so
every word is merged in the order in which it would be alone.

Null and empty texts have no ids. Texts of any length are encoded whole; rows are
independent, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import kept, lean, slices, texts_of

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: White space on which words never depend: it is dropped and composes with nothing.
PLAIN_WHITE = re.compile("[ \t\n\r]+")
#: Characters whose lower case, composition and class are the same in every Unicode version.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
PLAIN = re.compile(f"[\\t\\n\\r -~{LATIN}]*")
#: The vocabulary's word pattern over lower-case text of such characters.
WORD = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[!-/:-@\[-`{{-~]+"
)
MEMO_ENTRIES = 120_000
SLICE_BYTES = 3_000_000


def byte_letters() -> list[str]:
    """The letter of each byte: printable ones stand for themselves, others follow U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class PairIndexBpe:
    """A vocabulary file's encoder and decoder; merges are applied by pair index."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model = said["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        added = {token["content"]: token["id"] for token in said["added_tokens"]}
        size = 1 + max([*self.ids.values(), *added.values()])
        self.tokens = [""] * size
        for token, n in [*self.ids.items(), *added.items()]:
            self.tokens[n] = token
        self.added = added
        longest_first = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
        self.special = re.compile(f"({longest_first})") if added else None
        self.size = size
        #: left * (size + 1) + right -> rank; left, right and merged id by rank
        self.ranks: dict[int, int] = {}
        self.merges = []
        for rank, (left, right) in enumerate(model["merges"]):
            pair = self.ids[left] * (size + 1) + self.ids[right]
            self.ranks.setdefault(pair, rank)
            self.merges.append((self.ids[left], self.ids[right], self.ids[left + right]))
        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words_of(self, text: str) -> list[str]:
        """A text's words in order, by the vocabulary's own rules.

        Plain words are lower-case text, words of other texts strings of byte letters
        after a blank, and special tokens strings after two.
        """
        if PLAIN.fullmatch(text) and not (self.special and self.special.search(text)):
            return WORD.findall(text.lower())
        out = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append("  " + part)
                continue
            for chunk in filter(None, PLAIN_WHITE.split(part)):
                plain = self.library.normalizer.normalize_str(chunk)
                out += [" " + word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def spelled(self, word: str) -> str:
        """A word of ``words_of`` as byte letters."""
        if word[0] == " ":
            return word[1:]
        return word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))

    def merged(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, all words merged together."""
        border, size, ranks = self.size, self.size + 1, self.ranks
        symbols = [border]  # one border before, between and after the words
        for word in words:
            letters = [*word[:-1], word[-1] + self.suffix]
            symbols += [self.ids[c] for c in letters if c in self.ids]
            symbols.append(border)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for at, pair in enumerate(zip(symbols, symbols[1:])):
            known = ranks.get(pair[0] * size + pair[1])
            if known is not None:
                index.setdefault(known, []).append(at)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            places = index.pop(rank)
            places.sort()
            left_id, right_id, new = self.merges[rank]
            for turn, at in enumerate(places):
                right = after[at]
                if symbols[at] != left_id or symbols[right] != right_id:
                    continue
                beyond, back = after[right], before[at]
                symbols[at], symbols[right] = new, -1
                after[at], before[beyond] = beyond, at
                lowest = rank
                for place, pair in (
                    (at, new * size + symbols[beyond]),
                    (back, symbols[back] * size + new),
                ):
                    known = ranks.get(pair)
                    if known is not None:
                        lowest = min(lowest, known)
                        if known in index:
                            index[known].append(place)
                        else:
                            index[known] = [place]
                            heapq.heappush(active, known)
                if lowest < rank:  # the rest of the list waits for the lower rank
                    later = places[turn + 1 :]
                    if later and rank in index:
                        index[rank] += later
                    elif later:
                        index[rank] = later
                        heapq.heappush(active, rank)
                    break
        out: list[list[int]] = []
        own: list[int] = []
        for symbol in symbols[1:]:
            if symbol == border:
                out.append(own)
                own = []
            elif symbol >= 0:
                own.append(symbol)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. A bounded memo of two generations keeps frequent words."""
        if len(self.memo) > MEMO_ENTRIES:
            self.older, self.memo = self.memo, {}
        memo = self.memo
        split = [self.words_of(text) for text in texts]
        unknown = set().union(*split) - memo.keys()
        known = unknown & self.older.keys()
        memo.update((word, self.older[word]) for word in known)
        new = []
        for word in unknown - known:
            if word[:2] == "  ":
                memo[word] = np.array([self.added[word[2:]]], "<u4").tobytes()
            else:
                new.append(word)
        for word, ids in zip(new, self.merged([self.spelled(w) for w in new]), strict=True):
            memo[word] = array("I", ids).tobytes()
        return [np.frombuffer(b"".join(map(memo.__getitem__, found)), "<u4") for found in split]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces: these vocabularies name no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_coders: dict[str, PairIndexBpe] = kept(__name__)


def coder(path: str) -> PairIndexBpe:
    """One coder for each worker process and vocabulary."""
    if path not in _coders:
        _coders[path] = PairIndexBpe(path)
    return _coders[path]


def encode_documents(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array of int) and ``decoded`` text added."""
    schema = f"{docs.select('*').schema.simpleString()[7:-1]}"
    names = docs.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for part in slices(batches, text_col, SLICE_BYTES):
            found = bpe.encode(texts_of(part, text_col))
            ids = pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
            decoded = pa.array([bpe.decode(x) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, ids, decoded], names=[*names, "token_ids", "decoded"]
            )

    return docs.mapInArrow(lean(encode), f"{schema},token_ids:array<int>,decoded:string")


def bpe_digests(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the text decoded from them."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for part in slices(batches, "text", SLICE_BYTES):
            found = bpe.encode(texts_of(part, "text"))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in found]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(lean(digest), DIGESTS)
