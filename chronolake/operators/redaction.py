"""Records, summaries and search results under a privacy setting.

A tier decides which texts are sensitive and how they are masked: a word list,
or entities of personal data. A mode says what follows: ``reject`` refuses the
whole record, ``remove_paragraph`` takes out the parts with a hit, and ``mask``
masks them. All texts of a record go to a tier together, one Python pass a
tier; the rest is array expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans, words
from ..functions.privacy import LEAST_SCORE
from ..functions.text import percent_decoded

MODES = ("reject", "remove_paragraph", "mask")
CENSORED = "[censored]"
ROWS = 64
VERDICT = "array<struct<hit: boolean, masked: string>>"


@dataclass(frozen=True)
class Words:
    """Texts with a word of the list; its matches are blocked."""

    listed: tuple[str, ...]

    def judge(self, text: str) -> tuple[bool, str]:
        return words.has_match(text, self.listed), words.blocked(text, self.listed)


@dataclass(frozen=True)
class Entities:
    """Texts with personal data of these kinds; spans are replaced by their kind."""

    kinds: tuple[str, ...] = spans.KINDS
    surnames: tuple[str, ...] = spans.SURNAMES

    def judge(self, text: str) -> tuple[bool, str]:
        form, pieces = spans.normalized(text)
        back = lambda place: place + max(p for p in pieces if p[0] <= place)[1]
        family, context = (re.compile(p) for p in spans._patterns(self.surnames))
        found = [e | {"start": back(e["start"]), "end": back(e["end"])} for e in spans.find(form, self.kinds, family, context)]
        return any(e["score"] >= LEAST_SCORE for e in found), spans.replaced(text, found)


Tier = Words | Entities


def judged(texts: Column, tier: Tier, mode: str = "mask") -> Column:
    """``VERDICT`` on each text of an array; a null text has no hit. Masked texts come back in mode ``mask`` only."""

    @F.arrow_udf(VERDICT)
    def run(texts: pa.Array) -> pa.Array:
        kind, out = pa.list_(pa.struct([("hit", pa.bool_()), ("masked", pa.string())])), []
        # Texts are Python's a few rows at a time: a batch of long ones would take many times its size.
        for at in range(0, len(texts), ROWS):
            each = [[(False, t) if t is None else tier.judge(t) for t in row or ()] for row in texts.slice(at, ROWS).to_pylist()]
            out.append(pa.array([[{"hit": h, "masked": m if mode == "mask" else None} for h, m in row] for row in each], kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return run(texts)


def _checked(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")


def _field(value: Column, verdict: Column, mode: str) -> Column:
    return F.when(verdict["hit"], verdict["masked"] if mode == "mask" else F.lit(CENSORED)).otherwise(value)


def redacted_records(records: DataFrame, tier: Tier, mode: str) -> DataFrame:
    """Records (title, url, links: array<struct<url, text>>, boxes: array<string>, ...) under one tier.

    reject: a hit in any text refuses the record. remove_paragraph: title and
    URL with a hit become [censored], links and boxes with one are dropped; no
    links left is null. mask: title, link texts and boxes are masked, a URL
    with a hit is [censored]. URLs are judged decoded, links by their text.
    Null fields stay null.
    """
    _checked(mode)
    links, boxes = F.coalesce("links", F.array().cast(records.schema["links"].dataType)), F.coalesce("boxes", F.array().cast("array<string>"))
    texts = F.concat(F.array("title", percent_decoded(F.col("url"))), F.transform(links, lambda x: x["text"]), boxes)
    j = records.withColumn("_v", judged(texts, tier, mode)).withColumn("_n", F.size(links))
    v = F.col("_v")
    if mode == "reject":
        return j.filter(~F.exists(v, lambda x: x["hit"])).drop("_v", "_n")
    of_links, of_boxes = F.slice(v, F.lit(3), F.col("_n")), F.slice(v, F.col("_n") + 3, F.size(boxes))
    if mode == "mask":
        new_links = F.zip_with(links, of_links, lambda x, y: F.struct(x["url"].alias("url"), y["masked"].alias("text")))
        new_boxes = F.transform(of_boxes, lambda y: y["masked"])
    else:
        new_links = F.filter(links, lambda x, i: ~F.get(v, i + 2)["hit"])
        new_boxes = F.filter(boxes, lambda x, i: ~F.get(v, i + 2 + F.col("_n"))["hit"])
    out = j.withColumns({
        "title": _field(F.col("title"), v[0], mode),
        "url": _field(F.col("url"), v[1], "remove_paragraph"),
        "links": F.when(F.size(new_links) > 0, new_links),
        "boxes": F.when(F.col("boxes").isNotNull(), new_boxes),
    })
    return out.drop("_v", "_n")


def redacted_titles(records: DataFrame, tier: Tier, mode: str, title: str = "title") -> DataFrame:
    """Records of a list: a hit in the title refuses, censors or masks it."""
    _checked(mode)
    j = records.withColumn("_v", judged(F.array(title), tier, mode))
    if mode == "reject":
        return j.filter(~F.col("_v")[0]["hit"]).drop("_v")
    return j.withColumn(title, _field(F.col(title), F.col("_v")[0], mode)).drop("_v")


def redacted_summaries(summaries: DataFrame, tier: Words, mode: str) -> DataFrame:
    """Summaries (title, summary, ocr_summary, and the JSON texts key_points and evidence) under a word list.

    Without a hit a row is unchanged. mask: texts and the string values of the
    JSON are masked; remove_paragraph: texts with a hit become [censored], JSON
    parts with one null; reject: the row is dropped.
    """
    _checked(mode)
    texts, parts = ("title", "summary", "ocr_summary"), ("key_points", "evidence")
    j = summaries.withColumn("_v", judged(F.array(*texts), tier, mode))
    j = j.withColumns({f"_{p}": words.json_contains(F.col(p), list(tier.listed)) for p in parts})
    if mode == "reject":
        any_hit = F.exists("_v", lambda x: x["hit"]) | F.col("_key_points") | F.col("_evidence")
        return j.filter(~any_hit).select(*summaries.columns)
    out = {c: _field(F.col(c), F.col("_v")[i], mode) for i, c in enumerate(texts)}
    if mode == "mask":
        out |= {p: words.json_masked(F.col(p), list(tier.listed)) for p in parts}
    else:
        out |= {p: F.when(~F.col(f"_{p}"), F.col(p)) for p in parts}
    return j.withColumns(out).select(*summaries.columns)


def redacted_results(results: DataFrame, listed: Words, entities: Entities | None, mode: str) -> DataFrame:
    """Search results (title, text, ...): rows with a listed word in title or text always go.

    Personal data in the text is masked in mode ``mask``, and drops the row in the others.
    """
    _checked(mode)
    j = results.withColumn("_v", judged(F.array("title", "text"), listed, mode)).filter(~F.exists("_v", lambda x: x["hit"])).drop("_v")
    if entities is None:
        return j
    j = j.withColumn("_v", judged(F.array("text"), entities, mode))
    if mode != "mask":
        return j.filter(~F.col("_v")[0]["hit"]).drop("_v")
    return j.withColumn("text", F.col("_v")[0]["masked"]).drop("_v")
