"""A stated subset of YAML inside one document.

Accepted: ``key: scalar`` mappings, lists of scalars, lists of flat records,
and mappings whose values are any of these one level down (two-space indent,
list dashes at either column). Comments, also behind a value, and blank lines are skipped. Scalars
are plain words, simple quoted strings, decimal numbers, ISO dates, booleans
and null. Anything else is not YAML here and the text stays plain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersely.functions import compact_form as form
from tersely.functions.text import filled_lines, let, rstrip

# --- fixed values: scalar words of YAML 1.1 ---------------------------------
TRUE_WORDS = ("yes", "Yes", "YES", "true", "True", "TRUE", "on", "On", "ON")
FALSE_WORDS = ("no", "No", "NO", "false", "False", "FALSE", "off", "Off", "OFF")
NULL_WORDS = ("", "~", "null", "Null", "NULL")
# ----------------------------------------------------------------------------
_KEY = r"[\p{L}_][\p{L}\p{N}_./-]*+(?: [\p{L}\p{N}_./-]++)*+"
_DECIMAL = (
    r"-?(?:0\.0|0\.0{0,3}[1-9][0-9]{0,9}|(?![0-9.]{17})[1-9][0-9]{0,14}\.[0-9]{1,14})"
)
_NUMBER = rf"(?:0|-?[1-9][0-9]*|{_DECIMAL})"
_YEAR = r"(?!0000)[0-9]{4}"
_LEAP = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00)"
_DATE = (
    rf"(?:{_YEAR}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])"
    rf"|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)|{_LEAP}-02-29)"
)
_QUOTED = r"\"[^\"\\]*\"|'[^']*'"
_WORDS = r"[\p{L}_/](?:[^:#\t]|:(?! |$)|(?<! )#)*+"
# Words that begin with a digit and are no number: versions, addresses, amounts with a unit.
_COUNTED = r"[0-9]++(?:\.[0-9]++){2,}|[1-9][0-9]*+(?:\.[0-9]++)?[a-zA-Z%]++"
_VALUE = rf"(?:{_NUMBER}|{_DATE}|{_QUOTED}|{_WORDS}|{_COUNTED}|~)"
# lead spaces, dash of a pair, key, value of the key, value of a list item
# and a comment, which a blank must precede
LINE = rf"^( *)(?:(- )?({_KEY}):(?: +({_VALUE}))?|- +({_VALUE}))(?: *(?<= )#.*)? *$"
START = r"^---\s*$"
FIRST_LINE = r"^\s*(?:#|- |---\s*[\n\r]|[\p{L}_][^\n\r:]*+:(?:\s|$))"


def _scalar_text(raw: Column) -> Column:
    value = rstrip(raw)
    quoted = F.substring(value, F.lit(1), F.lit(1)).isin('"', "'")
    return (
        F.when(value.isin(*NULL_WORDS), F.lit("null"))
        .when(value.isin(*TRUE_WORDS), F.lit("true"))
        .when(value.isin(*FALSE_WORDS), F.lit("false"))
        .when(quoted, F.substring(value, F.lit(2), F.length(value) - 2))
        .when(value.rlike(rf"^{_DECIMAL}$"), F.regexp_replace(value, r"(\.[0-9]+?)0+$", "$1"))
        .otherwise(value)
    )


def _parse(line: Column) -> Column:
    part = lambda group: F.regexp_extract(line, LINE, group)
    return F.struct(
        F.length(part(1)).alias("lead"),
        ((part(2) != "") | (part(5) != "")).alias("dash"),
        part(3).alias("key"),
        let(F.concat(part(4), part(5)), _scalar_text).alias("value"),
        ((part(3) != "") & (part(4) == "")).alias("bare"),
    )


def _keys(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["key"])


def _usable(keys: Column) -> Column:
    """Keys that are distinct and stay strings in YAML."""
    words = TRUE_WORDS + FALSE_WORDS + NULL_WORDS
    return (F.size(F.array_distinct(keys)) == F.size(keys)) & ~F.exists(
        keys, lambda key: key.isin(*words)
    )


def _entry_lines(entries: Column, depth: Column) -> Column:
    return F.transform(
        entries, lambda e: F.concat(form.indent(depth), e["key"], F.lit(": "), e["value"])
    )


def _slices(entries: Column, starts: Column, skip: int) -> Column:
    """Entries from each start (less ``skip``) up to the next one."""
    end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(entries))
    return F.transform(
        starts,
        lambda at, k: F.slice(entries, at + 1 + skip, F.greatest(end(k) - at - skip, F.lit(0))),
    )


def _positions(entries: Column, test) -> Column:
    return F.filter(
        F.sequence(F.lit(0), F.size(entries) - 1), lambda i: test(F.get(entries, i))
    )


def _list_lines(body: Column, name: Column, depth: Column) -> Column:
    """Lines of a list of scalars or of flat records, NULL outside the subset."""
    base = F.get(body, F.lit(0))["lead"]
    shaped = F.forall(body, lambda e: e["lead"] + F.when(e["dash"], 2).otherwise(0) == base + 2)
    scalars = F.concat(
        F.array(F.concat(form.indent(depth), form.list_header(name, F.size(body)))),
        F.transform(body, lambda e: F.concat(form.indent(depth + 1), F.lit("- "), e["value"])),
    )
    records = let(
        _slices(body, _positions(body, lambda e: e["dash"]), 0),
        lambda items: F.when(
            F.forall(items, lambda item: _usable(_keys(item))),
            let(
                _keys(F.get(items, F.lit(0))),
                lambda keys: F.when(
                    F.forall(items, lambda item: _keys(item) == keys),
                    F.concat(
                        F.array(
                            F.concat(
                                form.indent(depth), form.table_header(name, F.size(items), keys)
                            )
                        ),
                        F.transform(
                            items,
                            lambda item: F.concat(
                                form.indent(depth + 1),
                                form.row(
                                    F.transform(item, lambda e: form.escape_cell(e["value"]))
                                ),
                            ),
                        ),
                    ),
                ).otherwise(
                    F.concat(
                        F.array(F.concat(form.indent(depth), form.list_header(name, F.size(items)))),
                        F.flatten(
                            F.transform(
                                items,
                                lambda item: F.concat(
                                    F.array(F.concat(form.indent(depth + 1), F.lit("-"))),
                                    _entry_lines(item, depth + 2),
                                ),
                            )
                        ),
                    )
                ),
            ),
        ),
    )
    return F.when(
        shaped,
        F.when(F.forall(body, lambda e: e["key"] == ""), scalars).when(
            F.forall(body, lambda e: e["key"] != ""), records
        ),
    )


def _group_lines(group: Column) -> Column:
    """Lines of one named value, NULL outside the subset."""
    body, name, depth = group["body"], group["name"], group["depth"]
    flat = F.forall(body, lambda e: (e["lead"] == 2) & ~e["dash"])
    title = F.concat(form.indent(depth), name, F.lit(":"))
    return F.when(
        F.size(body) == 0, F.array(F.concat(title, F.lit(" "), group["value"]))
    ).when(
        group["bare"],
        F.when(F.get(body, F.lit(0))["dash"], _list_lines(body, name, depth)).when(
            flat & _usable(_keys(body)),
            F.concat(F.array(title), _entry_lines(body, depth + 1)),
        ),
    )


def compact_lines(text: Column) -> Column:
    """Lines of the compact block for a YAML text, NULL outside the subset."""

    def with_entries(entries: Column) -> Column:
        is_list = F.get(entries, F.lit(0))["dash"]
        heads = _positions(entries, lambda e: (e["lead"] == 0) & ~e["dash"])
        bodies = lambda found: F.transform(
            _slices(entries, found, 1),
            lambda body, k: let(
                F.get(entries, F.get(found, k)),
                lambda head: F.struct(
                    head["key"].alias("name"),
                    head["value"].alias("value"),
                    head["bare"].alias("bare"),
                    F.lit(1).alias("depth"),
                    body.alias("body"),
                ),
            ),
        )
        whole = F.array(
            F.struct(
                F.lit(form.ROOT_NAME).alias("name"),
                F.lit("").alias("value"),
                F.lit(True).alias("bare"),
                F.lit(0).alias("depth"),
                entries.alias("body"),
            )
        )
        groups = F.when(is_list, whole).otherwise(let(heads, bodies))
        starts_flush = F.get(entries, F.lit(0))["lead"] == 0
        return F.when(starts_flush, let(groups, lambda found: rendered(found, is_list)))

    def rendered(groups: Column, is_list: Column) -> Column:
        names = F.transform(groups, lambda g: g["name"])
        title = F.when(is_list, F.array().cast("array<string>")).otherwise(
            F.array(F.lit(f"{form.ROOT_NAME}:"))
        )
        return F.when(
            _usable(names),
            let(
                F.transform(groups, _group_lines),
                lambda found: F.when(
                    F.forall(found, lambda g: g.isNotNull()), F.concat(title, F.flatten(found))
                ),
            ),
        )

    filled = F.filter(filled_lines(text), lambda line: ~line.rlike(r"^\s*#"))
    opened = lambda lines: F.when(  # noqa: E731  the first line may start a document
        F.get(lines, F.lit(0)).rlike(START), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    ).otherwise(lines)
    return let(
        let(filled, opened),
        lambda found: F.when(
            (F.size(found) > 0) & F.forall(found, lambda line: line.rlike(LINE)),
            let(F.transform(found, _parse), with_entries),
        ),
    )


def is_yaml(text: Column) -> Column:
    """True if the text lies in the subset and is a mapping or a list."""
    return F.when(text.rlike(FIRST_LINE), compact_lines(text).isNotNull()).otherwise(F.lit(False))


def record_block(text: Column) -> Column:
    """The text as a compact block, NULL outside the subset."""
    return form.block(compact_lines(text))
