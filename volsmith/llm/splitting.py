"""Splitting texts by a tokenizer's pattern."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex

#: Separators that the two expression libraries may not both call white space.
_DOUBTFUL = b"\x1c\x1d\x1e\x1f"


def latin_pattern(pattern: str) -> str | None:
    r"""``pattern`` for texts of code points below 256: ``\p{L}`` and ``\p{N}`` written out; None if it has other properties."""
    members = {kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
    parts, in_class = [], False
    for token in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if token.startswith((r"\p", r"\P")):
            if token[3:-1] not in members:
                return None
            token = members[token[3:-1]]
            parts.append(token if in_class else f"[{token}]")
            continue
        in_class = token == "[" or (in_class and token != "]")
        parts.append(token)
    return "".join(parts)


def _is_latin(text: str) -> bool:
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in data for c in _DOUBTFUL)


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern`` in a text; Western texts take a plainer expression with the same matches."""
    every = regex.compile(pattern).findall
    plain = latin_pattern(pattern)
    if plain is None:
        return every
    western = re.compile(plain).findall
    return lambda text: western(text) if _is_latin(text) else every(text)
