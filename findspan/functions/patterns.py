"""What a regular expression tells about the texts it can match."""

from __future__ import annotations

import re

# Anchors and look-arounds see the ends of a line, which a whole text does not have there; classes that
# exclude little may match line breaks but never need one, so they are safe.
REGEX_ONLY_INSIDE = re.compile(r"(?<!\\)[$]|(?<![\[\\])\^|\\[AzZG]|\(\?[=!<]")

# What ends a plain run, and what makes the character before it optional.
_SPECIAL = set("\\.^$|?*+()[]{}")
_LEAST = 2


def required_literals(pattern: str) -> list[str] | None:
    """Literals of which every match contains one; None if the pattern doesn't show any.

    Only plain runs outside of groups and classes count, for each alternative its longest. Patterns
    that ignore case, or with a group of alternatives only, give None.
    """
    if "(?" in pattern.replace("(?:", ""):
        return None
    runs: list[list[str]] = [[""]]
    depth, i = 0, 0
    while i < len(pattern):
        c, literal, width = pattern[i], None, 1
        if c == "\\":
            width = 2
            follows = pattern[i + 1 : i + 2]
            literal = follows if follows and not follows.isalnum() else None
        elif c == "[":
            end = pattern.index("]", i + 2) if "]" in pattern[i + 2 :] else len(pattern) - 1
            width = end - i + 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            runs.append([""])
        elif c == "{":
            width = pattern.find("}", i) - i + 1 or 1
        elif c not in _SPECIAL:
            literal = c
        follows = pattern[i + width : i + width + 1]
        if depth == 0 and literal and follows not in ("?", "*", "{"):
            runs[-1][-1] += literal
            if follows == "+":
                runs[-1].append("")
        else:
            runs[-1].append("")
        i += width
    longest = [max(r, key=len) for r in runs]
    return longest if all(len(x) >= _LEAST for x in longest) else None
