"""Sensitive words and personal data: tests and masks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as automata

# Fixed values of the identity-card checksum: weights of the 17 digits, and check characters by remainder.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
#: Entities under this score are dropped (a fixed value of the rule).
LEAST_SCORE = 0.3
#: Lists of more words than this are compiled into an automaton; results are the same.
LONG_LIST = 64


def word_pattern(words: list[str], boundary: bool = False) -> str:
    """One pattern for a word list: under two characters dropped, sorted, once each."""
    own = sorted({w for w in words if len(w) >= 2}, key=lambda w: (-len(w), w))
    body = "|".join(re.escape(w) for w in own) or r"[^\s\S]"
    return f"(?i)({body})" if not boundary else f"(?i)\\b({body})\\b"


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether a text contains a word of the list, case of ASCII letters aside; null: false."""
    if len(words) > LONG_LIST:
        return automata.contains(text, words)
    return F.coalesce(text.rlike(word_pattern(words)), F.lit(False))


def masked(text: Column, words: list[str]) -> Column:
    """Each character of each match replaced by a block.

    Matches and gaps alternate, so the text is rebuilt from both in order.
    """
    if len(words) > LONG_LIST:
        return automata.masked(text, words)
    p = word_pattern(words)
    gaps = F.split(text, p, -1)
    hits = F.regexp_extract_all(text, F.lit(p), F.lit(1))
    blocks = F.transform(hits, lambda h: F.repeat(F.lit("█"), F.length(h)))
    return F.when(text.isNotNull(), F.array_join(F.zip_with(gaps, blocks, lambda g, b: F.concat(F.coalesce(g, F.lit("")), F.coalesce(b, F.lit("")))), ""))


def redacted(text: Column, words: list[str], mode: str, kind: str = "text") -> Column:
    """A field under a mode: ``remove`` gives [censored], ``mask`` blocks; URLs are always [censored]."""
    hit = contains_any(text, words)
    return F.when(hit, F.lit("[censored]") if mode == "remove" or kind == "url" else masked(text, words)).otherwise(text)


def digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c.rlike("^[0-9]$")), lambda c: c.cast("int"))


def luhn(text: Column) -> Column:
    """16 to 19 digits whose sum, every second from the right doubled, divides by 10."""
    d = F.reverse(digits(text))
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.coalesce(text.rlike("^[0-9]{16,19}$") & (F.aggregate(twice, F.lit(0), lambda s, x: s + x) % 10 == 0), F.lit(False))


def id_card(text: Column) -> Column:
    """18 characters whose last follows from the weighted sum of the others by 11."""
    d = digits(F.substring(text, 1, 17))
    weights = F.array(*[F.lit(w) for w in ID_WEIGHTS])
    rest = F.aggregate(F.zip_with(d, weights, lambda a, b: a * b), F.lit(0), lambda s, x: s + x) % 11
    check = F.substring(F.lit(ID_CHECKS), (rest + 1).cast("int"), F.lit(1))
    return F.coalesce(text.rlike("^[0-9]{17}[0-9Xx]$") & (F.upper(F.substring(text, 18, 1)) == check), F.lit(False))


def id_card_15(text: Column) -> Column:
    """15 digits with a month and a day in their places."""
    month, day = F.substring(text, 9, 2).cast("int"), F.substring(text, 11, 2).cast("int")
    return F.coalesce(text.rlike("^[0-9]{15}$") & month.between(1, 12) & day.between(1, 31), F.lit(False))


#: Kinds of entities: pattern and score. Prefixes and lengths of MOBILE and BANK_CARD are fixed values of the number plans.
PATTERNS = {
    "EMAIL": (r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 0.5),
    "IP": (r"\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b", 0.4),
    "PHONE": (r"(\+?[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4})", 0.5),
    "MOBILE": (r"(?<![0-9])(1[3-9][0-9]{9})(?![0-9])", 0.5),
    "ID_CARD": (r"(?<![0-9])([0-9]{17}[0-9Xx])(?![0-9])", 0.4),
    "BANK_CARD": (r"(?<![0-9])([3-6][0-9]{15,18})(?![0-9])", 0.3),
}


def entities(text: Column) -> Column:
    """array<struct<kind, value, score>> of a text's entities that pass their validators."""
    out = []
    for kind, (pattern, score) in PATTERNS.items():
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
        if kind == "BANK_CARD":
            found = F.filter(found, luhn)
        if kind == "ID_CARD":
            found = F.filter(found, id_card)
        out.append(F.transform(found, _entity(kind, score)))
    # Every kind has an @ or a digit, so most texts are settled by one short pattern.
    return F.when(text.rlike("[@0-9]"), F.concat(*out)).otherwise(F.array().cast("array<struct<kind: string, value: string, score: double>>"))


def _entity(kind: str, score: float):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(score).alias("score"))


def has_pii(found: Column) -> Column:
    return F.exists(found, lambda e: e["score"] >= LEAST_SCORE)


def mask_pii(text: Column) -> Column:
    """E-mail addresses, phones and addresses of machines replaced by [KIND]."""
    out = text
    for kind in ("EMAIL", "PHONE", "IP"):
        out = F.regexp_replace(out, PATTERNS[kind][0], f"[{kind}]")
    return out


def normalize_digits(text: Column) -> Column:
    """Full-width digits to ASCII; spaces and dashes between digits dropped. ``spans.normalize`` has the way back."""
    wide = "".join(chr(0xFF10 + i) for i in range(10))
    return F.regexp_replace(F.translate(text, wide, "0123456789"), "(?<=[0-9])[ \\-\u2013\u2014]+(?=[0-9])", "")


#: A JSON string literal, with the colon that follows it if it is a key.
LITERAL = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?'


def leaves(json: Column) -> Column:
    """The string literals of a JSON text that are values, at any depth; keys and numbers are not."""
    return F.filter(F.regexp_extract_all(json, F.lit(LITERAL), F.lit(0)), lambda x: ~x.endswith(":"))


def json_contains(json: Column, words: list[str]) -> Column:
    """Whether a string value of a JSON text contains a word of the list; null: false.

    Values are searched as they are written, escapes included.
    """
    if len(words) > LONG_LIST:
        return automata.json_contains(json, words)
    return F.coalesce(F.exists(leaves(json), lambda x: x.rlike(word_pattern(words))), F.lit(False))


def json_masked(json: Column, words: list[str]) -> Column:
    """The JSON text with the words masked in its string values, at any depth."""
    if len(words) > LONG_LIST:
        return automata.json_masked(json, words)
    gaps, found = F.split(json, LITERAL, -1), F.regexp_extract_all(json, F.lit(LITERAL), F.lit(0))
    new = F.transform(found, lambda x: F.when(x.endswith(":"), x).otherwise(masked(x, words)))
    return F.array_join(F.zip_with(gaps, new, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")


def redacted_boxes(boxes: Column, words: list[str], mode: str) -> Column:
    """Texts under a mode: ``remove`` drops those with a hit (none left: null), ``mask`` masks them."""
    if mode == "mask":
        return F.transform(boxes, lambda b: masked(b, words))
    left = F.filter(boxes, lambda b: ~contains_any(b, words))
    return F.when(F.size(left) > 0, left)


def record_hit(title: Column, url: Column, boxes: Column, words: list[str]) -> Column:
    """Whether any field of a record contains a word: mode ``reject`` refuses it whole."""
    return contains_any(title, words) | contains_any(url, words) | F.coalesce(F.exists(boxes, lambda b: contains_any(b, words)), F.lit(False))
