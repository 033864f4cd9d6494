"""Text expressions: lines, positions, counting, patterns and globs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences(text: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("long")


def text_lines(text: Column) -> Column:
    """Lines of a text: a trailing newline adds no line, the carriage return before a newline is dropped."""
    closed = (
        F.when(text.endswith("\r\n"), F.left(text, F.length(text) - 2))
        .when(text.endswith("\n"), F.left(text, F.length(text) - 1))
        .otherwise(text)
    )
    return F.when(F.length(text) > 0, F.split(closed, r"\r?\n")).otherwise(F.array().cast("array<string>"))


def line_count(text: Column) -> Column:
    """Number of lines without building them."""
    breaks = occurrences(text, "\n")
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(
        breaks + F.when(text.endswith("\n"), 0).otherwise(1)
    ).cast("long")


def position(text: Column, offset: Column) -> tuple[Column, Column]:
    """1-based (line, column) of a 0-based character offset; past the end means the end."""
    head = F.left(text, F.greatest(offset, F.lit(0)).cast("int"))
    line = occurrences(head, "\n") + 1
    column = (F.length(F.substring_index(head, "\n", -1)) + 1).cast("long")
    return line, column


def bytes_of(text: Column) -> Column:
    return F.octet_length(text)


def sql_text(value: str) -> str:
    """SQL literal of a text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def match_columns(text: str, pattern: str) -> str:
    """SQL for all matches of a pattern as ``array<struct<column, matched>>`` with 1-based character columns.

    The text between the matches comes from ``split``, so a match starts after all earlier gaps
    and matches. Both arguments are SQL expressions; patterns must not match the empty string.
    """
    both = f"named_struct('found', regexp_extract_all({text}, {pattern}, 0), 'gaps', split({text}, {pattern}, -1))"

    def width(parts: str, count: str) -> str:
        return f"aggregate(slice({parts}, 1, {count}), 0, (total, part) -> total + length(part))"

    # The outer lambda names both arrays, so that they are built once per text and not per match.
    return (f"get(transform(array({both}), t -> transform(t.found, (m, i) -> named_struct("
            f"'column', 1 + {width('t.gaps', 'i + 1')} + {width('t.found', 'i')}, 'matched', m))), 0)")


def _alternatives(glob: str) -> list[str]:
    """Expand ``{a,b}`` groups."""
    group = re.search(r"\{([^{}]*)\}", glob)
    if not group:
        return [glob]
    head, tail = glob[: group.start()], glob[group.end():]
    return [full for part in group.group(1).split(",") for full in _alternatives(head + part + tail)]


def glob_regex(globs: str | Iterable[str], literal_separator: bool = False) -> str:
    """One anchored regular expression for one or many globs.

    ``**/`` spans any number of folders. ``*`` and ``?`` also match ``/`` unless
    ``literal_separator`` is set.
    """
    one = "[^/]" if literal_separator else "."
    wanted = [globs] if isinstance(globs, str) else list(globs)
    expanded = [single for glob in wanted for single in _alternatives(glob)]
    bodies = []
    for glob in expanded:
        body, i = "", 0
        while i < len(glob):
            if glob.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif glob.startswith("**", i):
                body, i = body + ".*", i + 2
            elif glob[i] == "*":
                body, i = body + one + "*", i + 1
            elif glob[i] == "?":
                body, i = body + one, i + 1
            elif glob[i] == "[" and "]" in glob[i + 2:]:
                end = glob.index("]", i + 2)
                inner = glob[i + 1:end]
                negated = "^" if inner[0] == "!" else ""
                body += "[" + negated + inner.lstrip("!").replace("\\", "\\\\") + "]"
                i = end + 1
            else:
                body, i = body + re.escape(glob[i]), i + 1
        bodies.append(body)
    return "^(?s:" + "|".join(f"(?:{b})" for b in bodies) + r")\z"


def extension(path: Column) -> Column:
    """File extension of the last path part, empty when there is none."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)
