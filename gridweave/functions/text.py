"""String functions of patterns as Column expressions.

Regular expressions are Java's with two flags set: `.` doesn't match line feeds only (?d),
and \\d, \\s, \\w are Unicode's (?U).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?dU)"
#: Characters that count as blank (white space without the no-break spaces, and the four separators below U+0020).
BLANK = r"\t\n\x0B\f\r\x1C-\x1F \u0085  -  -    　"


def quoted(text: str) -> str:
    """A Java pattern that matches the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def is_blank(c: Column) -> Column:
    """All characters are blank; the empty string is."""
    return ~c.rlike(f"[^{BLANK}]")


def matches(c: Column, pattern: str) -> Column:
    """The whole string matches."""
    return c.rlike(f"{FLAGS}\\A(?:{pattern})\\z")


def contains(c: Column, text: str) -> Column:
    return F.contains(c, F.lit(text))


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(c, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def normalized(c: Column) -> Column:
    """Without blanks at either end, and each run of ASCII white space one space."""
    return F.regexp_replace(F.regexp_replace(c, f"\\A[{BLANK}]+|[{BLANK}]+\\z", ""), r"[ \t\n\x0B\f\r]+", " ")


def replaced(c: Column, pattern: str, by: str) -> Column:
    """Every match replaced; $1 in `by` is a group."""
    return F.regexp_replace(c, FLAGS + pattern, by)


def sliced(c: Column, first: int, last: int) -> Column:
    """Code points from `first` up to `last`, counted from 0; what isn't there is left out."""
    return F.substring(c, first + 1, max(0, last - first))


def split(c: Column, text: str) -> Column:
    """Parts between the delimiters, empty ones too."""
    return F.split(c, quoted(text), -1)


def step(c: Column, what: tuple) -> Column:
    """One step of an item's extraction."""
    match what:
        case ("SUBSTR", first, last):
            return sliced(c, first, last)
        case ("REPL", pattern, by):
            return replaced(c, pattern, by)
        case ("NORM",):
            return normalized(c)
        case ("TRIM",):
            return trimmed(c)
        case ("UC",):
            return F.upper(c)
        case ("LC",):
            return F.lower(c)
        case ("CALL", call, True):
            return call(c)
        case ("CALL", call, False):
            return F.pandas_udf(lambda s: s.map(call, na_action="ignore"), "string")(c)
    raise ValueError(f"unknown step {what!r}")


def extracted(c: Column, steps: tuple[tuple, ...]) -> Column:
    for s in steps:
        c = step(c, s)
    return c


def java_blank(text: str) -> bool:
    """is_blank for a Python string."""
    return re.search(f"[^{BLANK}]", text) is None
