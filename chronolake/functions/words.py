"""Word lists of any length, as automata over Arrow batches.

A pattern of alternatives is tried word by word at each place of a text, so its
cost grows with the list. An automaton reads a text once, whatever the list.
It is compiled once in each Python worker, from the list that the function
carries. Matching is by ASCII case only, and words of under two characters are
left out, as in ``privacy.word_pattern``.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "█"
#: A JSON string literal, with the colon that follows it if it is a key.
LITERAL = re.compile(r'"(?:[^"\\]|\\.)*+"(?:\s*:)?', re.DOTALL)
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@functools.lru_cache(maxsize=8)
def machine(words: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for w in words:
        if len(w) >= 2:
            w = w.translate(UPPER)
            out.add_word(w, len(w))
    out.make_automaton()
    return out


def folded(text: str) -> str:
    """ASCII letters in lower case; every character keeps its place."""
    return text.lower() if text.isascii() else text.translate(UPPER)


def matches(text: str, words: tuple[str, ...], first_ending: bool = False) -> list[tuple[int, int]]:
    """(start, end) of the matches that don't overlap, from left to right.

    The longest of those that start leftmost, as the pattern of the list,
    longest first, has it. With ``first_ending`` whichever ends first, as an
    automaton that stops at each match has it: of "ab" and "abc" always "ab".
    """
    m = machine(words)
    if not len(m):
        return []
    if not first_ending:
        return [(end - n + 1, end + 1) for end, n in m.iter_long(folded(text))]
    out, free = [], 0
    for end, n in m.iter(folded(text)):
        if end - n + 1 >= free:
            out.append((end - n + 1, end + 1))
            free = end + 1
    return out


def has_match(text: str, words: tuple[str, ...]) -> bool:
    m = machine(words)
    return bool(len(m)) and next(m.iter(folded(text)), None) is not None


def blocked(text: str, words: tuple[str, ...], first_ending: bool = False) -> str:
    """The text with a block for each character of each match."""
    out, at = [], 0
    for start, end in matches(text, words, first_ending):
        out += [text[at:start], BLOCK * (end - start)]
        at = end
    return "".join([*out, text[at:]]) if out else text


def contains(text: Column, words: list[str]) -> Column:
    """Whether a text has a match; null: false."""
    own = tuple(sorted(set(words)))

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([t is not None and has_match(t, own) for t in s])

    return run(text)


def masked(text: Column, words: list[str], first_ending: bool = False) -> Column:
    """A text with its matches blocked; null stays null."""
    own = tuple(sorted(set(words)))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else blocked(t, own, first_ending) for t in s], dtype=object)

    return run(text)


def spans(text: Column, words: list[str], first_ending: bool = False) -> Column:
    """array<struct<start, end>> of the matches; null: none."""
    own = tuple(sorted(set(words)))

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in matches(t or "", own, first_ending)] for t in s])

    return run(text)


def json_contains(json: Column, words: list[str]) -> Column:
    """Whether a string value of a JSON text has a match, as it is written; keys and numbers don't count. Null: false."""
    own = tuple(sorted(set(words)))

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([t is not None and any(has_match(x[0], own) for x in LITERAL.finditer(t) if not x[0].endswith(":")) for t in s])

    return run(json)


def json_masked(json: Column, words: list[str]) -> Column:
    """A JSON text with the matches in its string values blocked, at any depth."""
    own = tuple(sorted(set(words)))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        new = lambda x: x[0] if x[0].endswith(":") else blocked(x[0], own)
        return pd.Series([None if t is None else LITERAL.sub(new, t) for t in s], dtype=object)

    return run(json)
