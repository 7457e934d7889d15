"""Rules on names, titles and paths as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def member(c: Column, values: list[str]) -> Column:
    """Lower-cased membership."""
    return F.lower(c).isin([v.lower() for v in values])


def excluded(title: Column, process: Column, contains: list[str], starts: list[str], user_words: list[str], processes: list[str]) -> Column:
    """An empty title, a word in its own case, a beginning, a user's word in any case, or a process."""
    out = F.coalesce(title, F.lit("")) == ""
    for w in contains:
        out = out | title.contains(w)
    for w in starts:
        out = out | title.startswith(w)
    for w in user_words:
        out = out | F.lower(title).contains(w.lower())
    return F.coalesce(out | F.lower(process).isin([p.lower() for p in processes]), F.lit(True))


def weak_label(label: Column, process_label: Column, generic: list[str]) -> Column:
    """Blank, equal to the process label, or a generic word."""
    return (F.trim(F.coalesce(label, F.lit(""))) == "") | (F.lower(label) == F.lower(process_label)) | member(F.trim(label), generic)


def strip_suffix(title: Column, apps: list[str]) -> Column:
    """The title without `` - App``; as it was if under two characters would be left."""
    short = F.regexp_replace(title, f" [-–] ({'|'.join(map(re.escape, apps))})$", "")
    return F.when(F.length(short) < 2, title).otherwise(short)


def rewrite_prefix(path: Column, prefixes: dict[str, str]) -> Column:
    """The longest known prefix replaced."""
    out = path
    for p in sorted(prefixes, key=len):
        out = F.when(path.startswith(p), F.concat(F.lit(prefixes[p]), F.substring(path, len(p) + 1, 1 << 30))).otherwise(out)
    return out


def box(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column, x4: Column, y4: Column) -> Column:
    """Eight numbers as four points."""
    return F.array(F.array(x1, y1), F.array(x2, y2), F.array(x3, y3), F.array(x4, y4))
