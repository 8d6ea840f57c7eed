"""String and array expressions, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when a text is stripped.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def before(text: Column, mark: str) -> Column:
    """The text up to the first ``mark``, or all of it."""
    return F.substring_index(text, mark, 1)


def after(text: Column, mark: str) -> Column:
    """The stripped text behind the first ``mark``, or ``''``."""
    start = F.locate(mark, text) + F.lit(len(mark))
    return F.when(text.contains(mark), strip(F.substr(text, start))).otherwise("")


def first_token(text: Column) -> Column:
    return F.regexp_extract(text, r"(\S+)", 1)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def any_cell_contains(cells: Column, word: str) -> Column:
    return F.exists(cells, lambda cell: cell.contains(word))


def any_cell_equals(cells: Column, value: str) -> Column:
    return F.array_contains(cells, value)


def dash_quotes(text: Column) -> Column:
    return F.translate(text, "'", "-")


def strip_quotes(text: Column) -> Column:
    return F.trim(text, F.lit("'\""))


def stripped_parts(text: Column, separator: str) -> Column:
    """Split on a one-character separator and strip each part."""
    return F.transform(F.split(text, f"[{separator}]", -1), strip)


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def tag_of(line: Column) -> Column:
    """The part of ``tag: value`` before the first colon and blank."""
    return F.substring_index(line, ": ", 1)


def value_of(line: Column) -> Column:
    return F.substr(line, F.locate(": ", line) + F.lit(2))


def python_bool(flag: Column) -> Column:
    return F.initcap(flag.cast("string"))
