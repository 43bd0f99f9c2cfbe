"""Comma or tab delimited text inside one document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersely.functions import compact_form as form
from tersely.functions.text import WHITE_SPACE, filled_lines, let

_EOL = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
LINE = rf"^[^{_EOL}]*+"


def _field(delimiter: str) -> str:
    # An optional quoted part (quotes doubled inside, may run over line ends),
    # then anything up to the delimiter. Possessive, so long lines need no
    # deep recursion in the regex engine.
    return rf"(?:\"(?:[^\"]++|\"\")*+(?:\"|\z))?+[^{delimiter}\n]*+"


def _rows(lines: Column, delimiter: str) -> Column:
    field = _field(delimiter)
    record = rf"{field}(?:{delimiter}{field})*+"
    # With a delimiter put in front every cell is a non-empty match.
    lead = F.lit("\t" if delimiter == r"\t" else delimiter)
    found = F.filter(
        F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(record), F.lit(0)),
        lambda text: text != "",
    )
    cells = lambda text: F.transform(
        F.regexp_extract_all(F.concat(lead, text), F.lit(rf"\G{delimiter}({field})"), F.lit(1)),
        _value,
    )
    # Without a quote every line is a row, and a plain split gives its cells.
    plain = F.transform(lines, lambda line: F.split(line, delimiter, -1))
    quoted = F.exists(lines, lambda line: F.contains(line, F.lit('"')))
    return F.when(quoted, F.transform(found, cells)).otherwise(plain)


def _value(raw: Column) -> Column:
    quoted = r"(?s)^\"((?:[^\"]++|\"\")*+)(?:\"|\z)(.*)$"
    inner = F.replace(F.regexp_extract(raw, quoted, 1), F.lit('""'), F.lit('"'))
    inner = F.replace(inner, F.lit("\n"), F.lit(""))
    return F.when(
        F.startswith(raw, F.lit('"')), F.concat(inner, F.regexp_extract(raw, quoted, 2))
    ).otherwise(raw)


def parse_rows(text: Column) -> Column:
    """Rows of cells, NULL unless the text is a table.

    The first two filled lines must hold a comma or a tab; a tab in the first
    line makes it tab-delimited; all rows must have the same width.
    """

    def with_lines(lines: Column) -> Column:
        marked = F.forall(
            F.slice(lines, F.lit(1), F.lit(2)),
            lambda line: F.contains(line, F.lit(",")) | F.contains(line, F.lit("\t")),
        )
        tabbed = F.contains(F.get(lines, F.lit(0)), F.lit("\t"))
        rows = F.when(tabbed, _rows(lines, r"\t")).otherwise(_rows(lines, ","))
        return F.when((F.size(lines) >= 2) & marked, let(rows, checked))

    def checked(rows: Column) -> Column:
        width = F.size(F.get(rows, F.lit(0)))
        even = F.forall(rows, lambda r: F.size(r) == width)
        return F.when(even, rows)

    def with_first(head: Column) -> Column:
        """``head``: the text from its first filled line on."""
        first = F.regexp_extract(head, LINE, 0)
        rest = F.substr(head, F.length(first) + 1)
        second = F.regexp_extract(F.ltrim(rest, F.lit(WHITE_SPACE)), LINE, 0)
        # Leading tabs belong to the lines; any tab leaves the question open.
        tab = F.contains(text, F.lit("\t"))
        may = (F.contains(first, F.lit(",")) & F.contains(second, F.lit(","))) | tab
        # Without quotes and tabs a first pair of lines with unequal commas settles it.
        commas = lambda line: F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
        uneven = ~tab & ~F.contains(text, F.lit('"')) & (commas(first) != commas(second))
        return F.when(may & (second != "") & ~uneven, let(filled_lines(text), with_lines))

    marked = F.contains(text, F.lit(",")) | F.contains(text, F.lit("\t"))
    return F.when(marked, let(F.ltrim(text, F.lit(WHITE_SPACE)), with_first))


def list_block(rows: Column) -> Column:
    """Rows as a compact nested list."""

    def one_row(cells: Column) -> Column:
        head = F.array(F.concat(form.indent(1), form.list_header("-", F.size(cells))))
        return F.concat(head, F.transform(cells, lambda c: F.concat(F.lit("    - "), c)))

    return form.block(
        F.concat(
            F.array(form.list_header(form.ROOT_NAME, F.size(rows))),
            F.flatten(F.transform(rows, one_row)),
        )
    )
