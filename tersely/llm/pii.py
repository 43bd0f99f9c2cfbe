"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, digits, plus signs, schemes and
identifier cues. A local parser for each kind reads outwards from its anchor, decides
the span's borders and validates it:

- email: local part to the left of the at-sign, dotted domain to the right;
- ip: four dotted digit runs, each at most 255;
- card: digits with single spaces or hyphens between them, 13 to 19, Luhn sum 0;
- phone: a plus sign and 9 to 15 digits among spaces, dots, hyphens and brackets.

Spans the anchors add to these four kinds:

- login: user and password between a scheme's ``://`` and an at-sign before the path;
- account: a country code, check digits and 11 to 30 letters or digits, single spaces
  allowed, with remainder 1 modulo 97, after a cue such as ``IBAN`` in any case and a few
  words such as ``number``; where words in capitals follow, the longest part that passes;
- address: an ``mailto:`` or ``tel:`` target that is none of the four kinds.

Matches of one kind do not overlap and are taken from the left; a match that fails its
check is dropped and its text is not tried again. Positions are code points, ends
exclusive. Null and empty texts have no spans; rows are independent, so repeated rows
and ids give repeated results. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import lean, slices, texts_of

#: Kinds in the order in which spans are listed (fixed values).
KINDS = ("email", "ip", "card", "phone", "login", "account", "address")
BASE_KINDS = KINDS[:4]

Span = tuple[str, int, int]

LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
DIGITS = frozenset("0123456789")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@")
#: Words and marks that may stand between a cue and its account (fixed values).
BETWEEN = re.compile(r"(?:[\s:#.=-]|(?:number|num|no|nr|code|is)\b){0,6}", re.IGNORECASE)
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,}")
LONGEST = 34  # letters and digits of an account
TARGET = re.compile(r"[^\s<>\"'?]+")

#: Anchor strings, in capitals and small letters of any kind, and the parser each one wakes (fixed values).
ANCHORS = {
    "@": "email",
    "+": "phone",
    "://": "login",
    "iban": "account",
    "account": "account",
    "mailto:": "address",
    "tel:": "address",
    **{digit: "digit" for digit in sorted(DIGITS)},
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor, kind in ANCHORS.items():
        for letters in product(*({c, c.upper()} for c in anchor)):
            found.add_word("".join(letters), (len(anchor), kind))
    found.make_automaton()
    return found


_made: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    """One automaton for each worker process."""
    if not _made:
        _made.append(_automaton())
    return _made[0]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def account_end(text: str, at: int) -> int | None:
    """Where the account that begins at ``at`` ends: the longest part up to a border that passes."""
    match = ACCOUNT.match(text, at)
    if not match:
        return None
    passed, signs = None, ""
    for place in range(at, match.end()):
        if text[place] == " ":
            continue
        signs += text[place]
        if len(signs) > LONGEST:
            break
        inside = text[place + 1 : place + 2]
        if len(signs) >= 15 and not (inside.isalnum() and inside.isascii()) and mod97(signs):
            passed = place + 1
    return passed


def _bare(address: str) -> list[str]:
    """The parts of a dotted address without leading zeros."""
    return [part.lstrip("0") for part in address.split(".")]


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def find_spans(text: str) -> list[Span]:
    """All spans of a text, ordered by kind as listed and then by start."""
    free = dict.fromkeys((*KINDS, "ip-run"), 0)  # where the next match of a kind may begin
    spans: dict[str, list[Span]] = {kind: [] for kind in KINDS}

    def take(kind: str, start: int, end: int, valid: bool = True) -> None:
        free[kind] = end
        if valid:
            spans[kind].append((kind, start, end))

    for last, (size, kind) in automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= free["card"]:
                if match := NUMBER.match(text, at):
                    digits = digits_of(match[0])
                    take("card", at, match.end(), 13 <= len(digits) <= 19 and luhn(digits))
                else:
                    free["card"] = at + 1
            if at >= free["ip"] and at >= free["ip-run"]:
                if match := QUAD.match(text, at):
                    small = all(len(p) <= 3 and int(p or 0) <= 255 for p in _bare(match[0]))
                    take("ip", at, match.end(), small)
                else:  # no other digit of this run begins one either
                    end = at + 1
                    while end < len(text) and text[end] in DIGITS:
                        end += 1
                    free["ip-run"] = end
        elif kind == "email":
            start = at
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (match := DOMAIN.match(text, at + 1)):
                take("email", start, match.end())
        elif kind == "phone":
            if at >= free["phone"] and (match := CALL.match(text, at)):
                take("phone", at, match.end(), 9 <= len(digits_of(match[0])) <= 15)
        elif at >= free[kind]:
            if kind == "login":
                if match := LOGIN.match(text, last + 1):
                    take("login", last + 1, match.end() - 1)
            elif kind == "account":
                start = BETWEEN.match(text, last + 1).end()
                if end := account_end(text, start):
                    take("account", start, end)
            elif match := TARGET.match(text, last + 1):
                take("address", *match.span())
    known = {(start, end) for kind in BASE_KINDS for _, start, end in spans[kind]}
    spans["address"] = [s for s in spans["address"] if s[1:] not in known]
    return [span for kind in KINDS for span in spans[kind]]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlaps become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: spans of each base kind counted, their digest, and all spans."""
    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string"
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [find_spans(text) for text in texts_of(part, "text")]
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
            counts = [
                pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64())
                for kind in BASE_KINDS
            ]
            digests = [hashlib.sha256(listed(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts, pa.array(digests), pa.array([listed(s) for s in found])],
                names=[
                    "doc_id", *(f"n_{kind}" for kind in BASE_KINDS), "base_sha256", "spans"
                ],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(lean(scan), schema)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data in ``text_col`` replaced by its kind."""
    names, place = docs.columns, docs.columns.index(text_col)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            column = part.column(place)
            texts = [
                None if text is None else masked(text, find_spans(text))
                for text in column.to_pylist()
            ]
            columns = [*part.columns]
            columns[place] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(lean(mask), docs.schema)
