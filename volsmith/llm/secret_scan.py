"""Secret scan: all rules in one minimised automaton, one pass over the bytes of each text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsmith.llm.automaton import compile_rules, ends_by_rule, first_start
from volsmith.llm.common import text_of
from volsmith.session import ship_package


@dataclass(frozen=True)
class Rule:
    """``least`` counts the characters of the match or, with ``value`` set, of its last part."""

    kind: str
    pattern: str
    least: int
    either_case: bool = False
    value: str = ""


# The base rules, then formats of well-known tokens.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True,
         "\"' "),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("private_key", r"-----BEGIN(\x20[A-Z]+)*\x20PRIVATE\x20KEY-----", 0),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
)
RULES = BASE_RULES + MORE_RULES
ADDED = ["spans"]


@lru_cache(maxsize=8)
def automata(rules: tuple[Rule, ...]):
    """The combined forward automaton, and a backward one for each rule."""
    patterns = [(r.pattern, r.either_case) for r in rules]
    return compile_rules(patterns, anywhere=True), [compile_rules([p], False, True) for p in patterns]


def value_length(match: str, quotes: str) -> int:
    """Characters of the value: what follows the first ``:`` or ``=``, blanks and one quote."""
    after = min(i for i in (match.find(":"), match.find("=")) if i >= 0) + 1
    value = match[after:].lstrip(" ")
    return len(value) - (value[:1] in ("'", '"') if quotes else 0)


def find_spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in code points, in order; leftmost, non-overlapping for each rule."""
    data = text.encode("utf-8", "surrogatepass")
    forward, backward = automata(rules)
    found = []
    for number, runs in ends_by_rule(forward, data).items():
        rule, free = rules[number], 0
        for _, end in runs:
            start = first_start(backward[number], data, end, free)
            if start is None:
                continue
            free = end
            match = data[start:end].decode("ascii")
            if (value_length(match, rule.value) if rule.value else len(match)) >= rule.least:
                found.append((start, number, end))
    if found and not data.isascii():
        found = [(len(data[:s].decode("utf-8", "surrogatepass")), n, len(data[:e].decode("utf-8", "surrogatepass")))
                 for s, n, e in found]
    return sorted(found)


def span_text(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of all spans, by start and then by rule, joined by commas."""
    @F.pandas_udf("string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([",".join(f"{rules[n].kind}:{s}:{e}" for s, n, e in find_spans(t, rules)) for t in batch])

    return scan(text)


def redacted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with every span replaced by its kind in square brackets; overlapping spans as one."""
    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_redact(t, rules) for t in batch])

    return redact(text)


def _redact(text: str, rules: tuple[Rule, ...]) -> str:
    parts, done = [], 0
    for start, number, end in find_spans(text, rules):
        if start >= done:
            parts += [text[done:start], f"[{rules[number].kind}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]]) if parts else text


def secret_scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` with ``spans``: ``kind:start:end``, comma-joined, ends exclusive.

    All rules are read in one pass over the UTF-8 bytes; ends of matches come from the combined
    automaton, their starts from reading backward. Matches of one rule do not overlap and the
    leftmost goes first; those that are too short are dropped after they have used up their
    place. Places count code points. A null or empty text has no spans; each row is scanned by itself,
    so repeated rows give repeated results; an empty table gives an empty result. An existing
    column ``spans`` is replaced.
    """
    ship_package(docs.sparkSession)
    return docs.withColumn("spans", span_text(text_of(text), rules))


def redact_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with all secrets in ``text`` replaced; a null text stays null."""
    ship_package(docs.sparkSession)
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), redacted(text_of(text), rules)))
