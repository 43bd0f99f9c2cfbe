"""JSON text: validity, tokens, scalar text, and flat record lists."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tersely.functions import compact_form as form
from tersely.functions.text import let

# JSON grammar pieces. Possessive throughout: linear time, no deep recursion.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_ATOM = rf"(?:{_STRING}|[^\s{{}}\[\]:,\"]++)"
_PAIR = rf"{_STRING}\s*+:\s*+{_ATOM}"
_FLAT_OBJECT = rf"\{{\s*+{_PAIR}(?:\s*+,\s*+{_PAIR})*+\s*+\}}"
RECORD_LIST = rf"\[\s*+{_FLAT_OBJECT}(?:\s*+,\s*+{_FLAT_OBJECT})*+\s*+\]"
TOKEN = rf"{_STRING}|[{{}}\[\]:,]|[^\s{{}}\[\]:,\"]++"
COARSE_TOKEN = rf"{RECORD_LIST}|{TOKEN}"
_START = r'^[ \t\n\r]*(?:[\[{"\-0-9]|true|false|null)'


def is_json(text: Column) -> Column:
    """True if the whole text is one JSON value, scalars included.

    ``try_parse_json`` checks the grammar strictly but stops after the first
    value; the array length catches anything that follows it. The first
    character rules prose out without starting a parser.
    """
    wrapped = F.concat(F.lit('{"w":'), text, F.lit("}"))
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    valid = F.try_parse_json(wrapped).isNotNull() & F.coalesce(alone, F.lit(False))
    return F.when(text.rlike(_START), valid).otherwise(F.lit(False))


def string_value(token: Column) -> Column:
    """Text of a quoted JSON string."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    parsed = F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")
    return F.when(F.contains(token, F.lit("\\")), parsed).otherwise(plain)


def number_value(token: Column) -> Column:
    """Text of a JSON number: integers as written, others in shortest form."""
    is_int = token.rlike(r"^-?\d+$")
    integer = F.when(token == "-0", F.lit("0")).otherwise(token)
    return F.when(is_int, integer).otherwise(let(_decimal_parts(token), _float_text))


def _decimal_parts(token: Column) -> Column:
    # Up to 15 significant digits a number keeps the digits it is written
    # with; beyond that the nearest double decides.
    pattern = r"^-?(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?$"
    written = F.regexp_replace(
        F.concat(F.regexp_extract(token, pattern, 1), F.regexp_extract(token, pattern, 2)),
        "^0+",
        "",
    )
    source = F.when(F.length(F.regexp_replace(written, "0+$", "")) <= 15, token).otherwise(
        let(token.cast("double"), _shortest)
    )

    def parts(number: Column) -> Column:
        whole = F.regexp_extract(number, pattern, 1)
        fraction = F.regexp_extract(number, pattern, 2)
        exponent = F.coalesce(F.regexp_extract(number, pattern, 3).try_cast("int"), F.lit(0))
        digits = F.concat(whole, fraction)
        significant = F.regexp_replace(digits, "^0+", "")
        return F.struct(
            F.regexp_replace(significant, "0+$", "").alias("digits"),
            # Position of the decimal point relative to the first digit.
            (
                F.length(whole) - (F.length(digits) - F.length(significant)) + exponent
            ).alias("point"),
            F.when(F.startswith(token, F.lit("-")), F.lit("-")).otherwise(F.lit("")).alias("sign"),
            F.abs(token.cast("double")).alias("size"),
        )

    return let(source, parts)


def _shortest(number: Column) -> Column:
    """The fewest digits, 15 to 17, that read back as the same double."""
    forms = [F.format_string(f"%.{places}e", number) for places in (14, 15, 16)]
    return (
        F.when(forms[0].cast("double") == number, forms[0])
        .when(forms[1].cast("double") == number, forms[1])
        .otherwise(forms[2])
    )


def _float_text(parts: Column) -> Column:
    digits, point = parts["digits"], parts["point"]
    count = F.length(digits)
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= count, F.concat(digits, F.repeat(F.lit("0"), point - count), F.lit(".0")))
        .otherwise(
            F.concat(
                F.substring(digits, F.lit(1), point),
                F.lit("."),
                F.substring(digits, point + 1, count),
            )
        )
    )
    power = point - 1
    scientific = F.concat(
        F.substring(digits, F.lit(1), F.lit(1)),
        F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), count))).otherwise(""),
        F.lit("e"),
        F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
        F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(power).cast("string"),
    )
    text = (
        F.when(parts["size"] == F.lit(float("inf")), F.lit("inf"))
        .when((parts["size"] == 0) | (digits == ""), F.lit("0.0"))
        .when((point > -4) & (point <= 16), plain)
        .otherwise(scientific)
    )
    return F.concat(parts["sign"], text)


def atom_value(token: Column) -> Column:
    """Text of a scalar token."""
    return (
        F.when(F.startswith(token, F.lit('"')), string_value(token))
        .when(token.isin("null", "true", "false"), token)
        .otherwise(number_value(token))
    )


def record_lists(token: Column) -> Column:
    """Struct ``(keys, rows, count)`` of a flat record list, NULL if keys differ.

    ``rows`` holds the finished comma rows. A repeated key keeps its first
    place and its last value.
    """
    objects = F.regexp_extract_all(token, F.lit(_FLAT_OBJECT), F.lit(0))
    pair = rf"({_STRING})\s*+:\s*+({_ATOM})"

    def split_pairs(obj: Column) -> Column:
        return F.struct(
            F.transform(F.regexp_extract_all(obj, F.lit(pair), F.lit(1)), string_value).alias("k"),
            F.regexp_extract_all(obj, F.lit(pair), F.lit(2)).alias("v"),
        )

    def finished(items: Column) -> Column:
        keys = F.array_distinct(F.get(items, F.lit(0))["k"])
        same = lambda first: F.forall(
            items, lambda item: F.array_distinct(item["k"]) == first
        )
        return let(
            keys,
            lambda first: F.when(
                same(first),
                F.struct(
                    first.alias("keys"),
                    F.transform(items, lambda item: render(item, first)).alias("rows"),
                    F.size(items).alias("count"),
                ),
            ),
        )

    def render(item: Column, keys: Column) -> Column:
        cells = lambda values: form.row(
            F.transform(values, lambda v: form.escape_cell(atom_value(v)))
        )
        last = lambda key: F.get(
            item["v"],
            F.size(item["k"])
            - F.array_position(F.reverse(item["k"]), key).cast("int"),
        )
        return F.when(F.size(item["k"]) == F.size(keys), cells(item["v"])).otherwise(
            cells(F.transform(keys, last))
        )

    return let(F.transform(objects, split_pairs), finished)


NO_RECORDS = "struct<keys:array<string>,rows:array<string>,count:int>"


def _with_context(found: Column) -> Column:
    """Token structs less the keys and colons, which move into their value.

    Struct fields: ``tok`` the raw token, ``rec`` a record list or NULL,
    ``label`` the quoted key or NULL, ``empty`` true for an empty container.
    """

    def value_at(i: Column) -> Column:
        token = F.get(found, i)
        return F.struct(
            token["tok"].alias("tok"),
            token["rec"].alias("rec"),
            F.when(F.get(found, i - 1)["tok"] == ":", F.get(found, i - 2)["tok"]).alias("label"),
            F.coalesce(F.get(found, i + 1)["tok"].isin("]", "}"), F.lit(False)).alias("empty"),
        )

    is_value = lambda i: (F.get(found, i)["tok"] != ":") & F.coalesce(
        F.get(found, i + 1)["tok"] != ":", F.lit(True)
    )
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.size(found) - 1), is_value), value_at
    )


def tokens(text: Column) -> Column:
    """Values, brackets and commas of a JSON text; see ``_with_context``.

    A flat record list with equal keys is one token.
    """

    def refine(token: Column) -> Column:
        # Only a record list starts with a bracket and is longer than it.
        is_list = F.startswith(token, F.lit("[")) & (F.length(token) > 1)
        return let(
            F.when(is_list, record_lists(token)),
            lambda rec: F.when(
                is_list & rec.isNull(),
                F.transform(
                    F.regexp_extract_all(token, F.lit(TOKEN), F.lit(0)),
                    lambda t: F.struct(
                        t.alias("tok"), F.lit(None).cast(NO_RECORDS).alias("rec")
                    ),
                ),
            ).otherwise(F.array(F.struct(token.alias("tok"), rec.alias("rec")))),
        )

    coarse = F.regexp_extract_all(text, F.lit(COARSE_TOKEN), F.lit(0))
    return let(F.flatten(F.transform(coarse, refine)), _with_context)


def plain_tokens(text: Column) -> Column:
    """The same with every record on its own."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)),
        lambda t: F.struct(t.alias("tok"), F.lit(None).cast(NO_RECORDS).alias("rec")),
    )
    return let(found, _with_context)


def repeated_keys(text: Column) -> Column:
    """True if some object of a valid JSON text repeats a key."""
    key_or_string = F.lit(rf"({_STRING}\s*+:)|{_STRING}")
    count = lambda t: F.size(
        F.filter(F.regexp_extract_all(t, key_or_string, F.lit(1)), lambda k: k != "")
    )
    merged = F.to_json(F.try_parse_json(text))
    return count(text) != count(merged)


_PIECE = re.compile(TOKEN, re.DOTALL)


def with_last_values(text: str) -> str:
    """A valid JSON text whose objects repeat no key: the last value stands at the first one's place.

    Every other token is kept as it is written. Objects are held as maps from the key's text,
    so one pass over the tokens does for any depth.
    """
    outer: list[tuple] = []
    opening, held, key, raw = "", [], None, ""
    for token in _PIECE.findall(text):
        if token in "{[":
            outer.append((opening, held, key, raw))
            opening, held, key, raw = token, {} if token == "{" else [], None, ""
            continue
        if token in ":,":
            continue
        if token in "}]":
            inside = (f"{name}:{value}" for name, value in held.values()) if opening == "{" else held
            value = opening + ",".join(inside) + token
            opening, held, key, raw = outer.pop()
        elif opening == "{" and key is None:
            key, raw = json.loads(token) if "\\" in token else token[1:-1], token
            continue
        else:
            value = token
        if opening == "{":
            held[key] = held.get(key, (raw,))[0], value
            key = None
        else:
            held.append(value)
    return "".join(held)


@F.pandas_udf(ArrayType(StringType()))
def _resolved_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda found: [with_last_values(t) for t in found] if len(found) else None)


def _resolved(repeating: Column) -> Column:
    # Empty arrays in place of NULLs: Arrow's lists count the NULLs before a row again for each row.
    return _resolved_texts(F.coalesce(repeating, F.array().cast("array<string>")))


def repeating_texts(texts: Column) -> Column:
    """Of an array of texts the JSON ones that repeat a key; NULL if there is none."""
    # Two keys need two colons.
    may_repeat = lambda t: (F.substring_index(t, ":", 2) != t) & t.rlike(r"^\s*[\[{]")
    found = F.filter(texts, lambda t: F.coalesce(may_repeat(t) & repeated_keys(t), F.lit(False)))
    return let(F.array_distinct(found), lambda some: F.when(F.size(some) > 0, some))


def resolved(texts: Column) -> Column:
    """Array of the rewritten forms of those texts of an array that repeat a key; NULL if none does.

    Only these leave the JVM, in Arrow batches.
    """
    return _resolved(repeating_texts(texts))


def resolved_forms(repeating: Column) -> Column:
    """Map from each text of a column of ``repeating_texts`` to its rewritten form; NULL if there is none."""
    return F.map_from_arrays(repeating, _resolved(repeating))
