"""Scalar text functions: Column in, Column out, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# White space as the reference semantics define it (Unicode spaces and the
# ASCII separators 1C-1F).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
OTHER_LINE_END = r"[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
ENV_ASSIGNMENT = (
    r"(?U)(\b(?:export\s+)?)([A-Z][A-Z0-9_]{1,63})\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+)"
)
CHARS_PER_TOKEN = 4
NOT_BLANK = f"[^{WHITE_SPACE}]"
# ----------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    An expression named several times in a lambda would be re-evaluated for
    every element; the end of a fold over nothing binds it to a lambda variable instead.
    An item of a one-element array would do too, but asks for the type of ``body``, lambdas
    inside and all, again for each row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.trim(text, F.lit(WHITE_SPACE))


def rstrip(text: Column) -> Column:
    """Remove trailing Unicode white space."""
    return F.rtrim(text, F.lit(WHITE_SPACE))


def _parts(text: Column) -> Column:
    """Text between line ends; a plain split where newlines are the only ones."""
    return F.when(text.rlike(OTHER_LINE_END), F.split(text, LINE_END, -1)).otherwise(
        F.split(text, "\n", -1)
    )


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line end opens no further line."""
    return let(
        _parts(text),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def filled_lines(text: Column) -> Column:
    """Lines that hold more than white space."""
    return F.filter(_parts(text), lambda line: line.rlike(NOT_BLANK))


def estimate_tokens(text: Column) -> Column:
    """Character-count token estimate: ceil(code points / 4)."""
    return tokens_of_chars(F.length(text))


def tokens_of_chars(chars: Column) -> Column:
    """The estimate for a text of ``chars`` code points."""
    return F.ceil(chars / F.lit(CHARS_PER_TOKEN)).cast("long")


def input_bytes(text: Column) -> Column:
    """Size of the UTF-8 form."""
    return F.octet_length(text)


def redact_assignments(text: Column) -> Column:
    """Replace the value of every upper-case ``KEY=value`` by ``***``."""
    return F.regexp_replace(text, ENV_ASSIGNMENT, r"$1$2=***")


def redact_keys(text: Column, key_pattern: str) -> Column:
    """The same for caller-chosen keys; ``key_pattern`` is a regex without groups."""
    pattern = rf"(?U)(\b(?:export\s+)?)({key_pattern})\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+)"
    return F.regexp_replace(text, pattern, r"$1$2=***")


def content_hash(text: Column) -> Column:
    """SHA-256 hex of the UTF-8 form."""
    return F.sha2(text, 256)


def audit_hash(text: Column) -> Column:
    """Hash of the redacted text in audit form."""
    return F.concat(F.lit("sha256:"), content_hash(redact_assignments(text)))


def tool_label(tool: Column) -> Column:
    """Trimmed tool name, ``unknown`` when blank or missing."""
    return F.coalesce(F.nullif(strip(tool), F.lit("")), F.lit("unknown"))


def compression_ratio(tokens_in: Column, tokens_out: Column) -> Column:
    """(out - in) / in, zero for an empty input."""
    ratio = F.try_divide((tokens_out - tokens_in).cast("double"), tokens_in)
    return F.coalesce(ratio, F.lit(0.0))


def delta_percent(tokens_in: Column, tokens_out: Column) -> Column:
    """Change in percent, two places."""
    return F.round(compression_ratio(tokens_in, tokens_out) * 100.0, 2)


def newlines(text: Column) -> Column:
    """Number of newline characters."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def chunks(text: Column, size: int) -> Column:
    """Cut a text into pieces of at most ``size`` code points.

    A piece ends after the last newline of its window unless that newline is
    the window's first character; an empty text is one empty chunk.
    """
    size = max(1, size)
    if size == 1:
        pattern = r"(?s)."
    else:
        pattern = rf"(?s).{{1,{size}}}\z|.{{1,{size - 1}}}\n|.{{1,{size}}}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)
