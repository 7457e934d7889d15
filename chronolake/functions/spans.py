"""Spans of personal data: found in normalized text, mapped back, merged and masked.

Normalization drops characters, so a place in the normalized text is the place
in the text plus a shift that only changes where something was dropped: a
text's map is the list of those pieces. Finding runs over Arrow batches; maps,
merges and masks are array expressions.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .privacy import ID_CHECKS, ID_WEIGHTS, LEAST_SCORE

SPAN = "array<struct<kind: string, start: int, end: int, score: double>>"
MAP = "struct<text: string, pieces: array<struct<at: int, shift: int>>>"

# Fixed values of the rules for personal data: what is dropped between digits, patterns with their scores, the
# words beside a name and how far they reach, and the endings of the parts of an address.
WIDE_DIGITS = {0xFF10 + i: ord("0") + i for i in range(10)}
BETWEEN_DIGITS = re.compile("[ \\-\u2013\u2014]+")
PATTERNS = {
    "EMAIL": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.5),
    "IP": (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.4),
    "PHONE": (r"\+?[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-?[0-9]{4}", 0.5),
    "MOBILE": (r"(?<!\d)1[3-9]\d{9}(?!\d)", 0.5),
    "LANDLINE": (r"(?<!\d)(?:0\d{2,3}-?)?\d{7,8}(?!\d)", 0.3),
    "ID_CARD": (r"(?<!\d)[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)", 0.4),
    "ID_CARD_15": (r"(?<!\d)[1-9]\d{5}\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}(?!\d)", 0.35),
    "BANK_CARD": (r"(?<!\d)[3-6]\d{15,18}(?!\d)", 0.3),
}
NAME_SCORE, ADDRESS_SCORE, CONTEXT_REACH = 0.55, 0.7, 10
NAME_CONTEXT = ("姓名", "名叫", "化名", "用户名", "被告人", "犯罪嫌疑人", "嫌疑人", "当事人", "受害人", "被害人", "证人", "原告", "被告", "先生", "女士", "同志", "老师", "同学", "经理", "主任")
PROVINCE_ENDS = ("省", "自治区")
CITY_ENDS = ("市", "自治州", "地区", "盟")
DISTRICT_ENDS = ("区", "县", "旗", "市")
STREET_ENDS = ("路", "街", "巷", "道", "村", "镇", "号", "弄", "室", "栋", "单元", "层", "楼")

#: The hundred most common surnames and some of two characters; a longer list is a parameter.
SURNAMES = tuple("王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤劳") + ("欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "令狐", "慕容", "司徒", "公孙", "宇文", "长孙", "尉迟", "轩辕")

COMPILED = {k: (re.compile(p), s) for k, (p, s) in PATTERNS.items()}
CJK_RUN = re.compile("[\u4e00-\u9fff]+")
STREET_RUN = re.compile("[\u4e00-\u9fff0-9]*")


# Plain helpers, run a text at a time inside tasks


def normalized(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with plain digits and nothing between them, and its map: (place, shift from there on)."""
    text = text.translate(WIDE_DIGITS)
    out, pieces, at = [], [(0, 0)], 0
    dropped = 0
    for m in BETWEEN_DIGITS.finditer(text):
        if 0 < m.start() and m.end() < len(text) and text[m.start() - 1].isdigit() and text[m.end()].isdigit():
            out.append(text[at : m.start()])
            at = m.end()
            dropped += m.end() - m.start()
            pieces.append((at - dropped, dropped))
    return "".join([*out, text[at:]]), pieces


def luhn(digits: str) -> bool:
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def id_card(card: str) -> bool:
    return ID_CHECKS[sum(int(c) * w for c, w in zip(card, ID_WEIGHTS, strict=False)) % 11] == card[17].upper()


VALID = {"BANK_CARD": luhn, "ID_CARD": id_card}


def names(text: str, surnames: re.Pattern, context: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of a surname and one or two more characters that a context word stands near.

    Both lists of matches are in order: a candidate joins the context words
    that lie within ``CONTEXT_REACH`` characters of it on both sides.
    """
    beside = sorted((m.start(1), m.end(1)) for m in context.finditer(text))
    if not beside:
        return
    starts = [b[0] for b in beside]
    for m in surnames.finditer(text):
        for end in (m.end() + 1, m.end() + 2):
            if end <= len(text) and all("\u4e00" <= c <= "\u9fff" for c in text[m.end() : end]):
                k = bisect.bisect_left(starts, m.start() - CONTEXT_REACH)
                while k < len(beside) and beside[k][0] < end + CONTEXT_REACH:
                    if beside[k][1] <= end + CONTEXT_REACH:
                        yield m.start(), end
                        break
                    k += 1


def _places(run: str, ends: tuple[str, ...]) -> list[tuple[int, int]]:
    return sorted((i, i + len(e)) for e in ends for i in range(len(run)) if run.startswith(e, i))


def _joined(first: list[tuple[int, int]], then: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of ``first`` that a place of ``then`` follows, two characters or more between."""
    last = then[-1][0] if then else -1
    return [p for p in first if p[1] + 2 <= last]


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of a province, a city and a district with streets after them, the longest from where each begins.

    The endings of the three parts are found by place in each run of CJK
    characters, and joined from the last to the first; every place is looked
    at once, however long the run.
    """
    free = 0
    for m in CJK_RUN.finditer(text):
        # Streets may have taken the beginning of this run, digits between.
        begin = max(m.start(), free)
        while begin < m.end():
            run = text[begin : m.end()]
            districts = _places(run, DISTRICT_ENDS)
            cities = _joined(_places(run, CITY_ENDS), districts)
            provinces = [p for p in _joined(_places(run, PROVINCE_ENDS), cities) if p[0] >= 2]
            if not provinces:
                break
            city = max(c for c in cities if c[0] >= provinces[-1][1] + 2)
            end = begin + max(d for d in districts if d[0] >= city[1] + 2)[1]
            tail = STREET_RUN.match(text, end)[0]
            streets = [s for s in _places(tail, STREET_ENDS) if s[0] >= 1]
            end += streets[-1][1] if streets else 0
            yield begin, end
            begin = free = end


def find(text: str, kinds: tuple[str, ...], surnames: re.Pattern, context: re.Pattern) -> list[dict]:
    """The spans of a text that their validators accept, by kind and place."""
    # What a kind can't do without is looked for first: most texts have neither.
    needs = {"EMAIL": "@" in text, "NAME": CJK_RUN.search(text), "ADDRESS": CJK_RUN.search(text)}
    digits = any(d in text for d in "0123456789") or not text.isascii()
    out = []
    for kind in kinds:
        if not needs.get(kind, digits):
            continue
        if kind in COMPILED:
            pattern, score = COMPILED[kind]
            spans = [m.span() for m in pattern.finditer(text) if kind not in VALID or VALID[kind](m[0])]
        elif kind == "NAME":
            spans, score = list(dict.fromkeys(names(text, surnames, context))), NAME_SCORE
        else:
            spans, score = list(addresses(text)), ADDRESS_SCORE
        out += [{"kind": kind, "start": a, "end": b, "score": score} for a, b in spans]
    return out


# Columns

KINDS = (*PATTERNS, "NAME", "ADDRESS")


ARROW_MAP = pa.struct([("text", pa.string()), ("pieces", pa.list_(pa.struct([("at", pa.int32()), ("shift", pa.int32())])))])
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def few_at_a_time(texts: pa.Array, run: Callable, kind: pa.DataType, rows: int = 64) -> pa.Array:
    """``run`` of each text; Python holds so many texts and results at once, whatever the batch."""
    out = [pa.array([run(t) for t in texts.slice(at, rows).to_pylist()], kind) for at in range(0, len(texts), rows)]
    return pa.concat_arrays(out) if out else pa.array([], kind)


def _patterns(surnames: tuple[str, ...]) -> tuple[str, str]:
    family = "|".join(map(re.escape, sorted(surnames, key=lambda x: (-len(x), x)))) or r"[^\s\S]"
    return family, f"(?=({'|'.join(sorted(NAME_CONTEXT, key=len))}))"


def normalize(text: Column) -> Column:
    """``MAP`` of a text: its normalized form and the pieces of the way back; null stays null."""

    def one(t: str | None) -> dict:
        form, pieces = normalized(t) if t is not None else (None, None)
        return {"text": form, "pieces": pieces and [{"at": a, "shift": b} for a, b in pieces]}

    @F.arrow_udf(MAP)
    def run(texts: pa.Array) -> pa.Array:
        return few_at_a_time(texts, one, ARROW_MAP)

    out = run(text)
    return F.when(text.isNotNull(), out)


def found(text: Column, kinds: tuple[str, ...] = KINDS, surnames: tuple[str, ...] = SURNAMES) -> Column:
    """``SPAN`` of a text's entities, in its own places; null: none.

    Longer surnames go first, and context words are found however they overlap.
    """
    family, context = _patterns(surnames)

    @F.arrow_udf(SPAN)
    def run(texts: pa.Array) -> pa.Array:
        a, b = re.compile(family), re.compile(context)
        return few_at_a_time(texts, lambda t: find(t, kinds, a, b) if t else [], ARROW_SPAN)

    return run(text)


def original(place: Column, pieces: Column) -> Column:
    """The place in the text of a place in its normalized form."""
    return place + F.element_at(F.filter(pieces, lambda p: p["at"] <= place), -1)["shift"]


def remapped(entities: Column, pieces: Column) -> Column:
    """Entities of a normalized text in places of the text itself."""
    return F.transform(entities, lambda e: F.struct(e["kind"].alias("kind"), original(e["start"], pieces).alias("start"), original(e["end"], pieces).alias("end"), e["score"].alias("score")))


def merged(entities: Column, least: float = LEAST_SCORE) -> Column:
    """Entities of the least score or more, those that overlap as one span of the first one's kind.

    The first is the one that starts first, and of those the longest.
    """
    good = F.filter(entities, lambda e: (e["score"] >= least) & (e["start"] < e["end"]))
    ranked = F.sort_array(F.transform(good, lambda e: F.struct(e["start"].alias("start"), (-e["end"]).alias("back"), e["kind"].alias("kind"))))
    # Of equal spans the one that came first names the kind, as a stable order has it.
    place = lambda k: F.array_min(F.transform(F.filter(F.transform(good, lambda e, i: F.struct(e["start"].alias("s"), e["end"].alias("e"), i.alias("i"))), lambda x: (x["s"] == k["start"]) & (x["e"] == -k["back"])), lambda x: x["i"]))
    named = F.transform(ranked, lambda k: F.struct(k["start"].alias("start"), (-k["back"]).alias("end"), F.get(good, place(k))["kind"].alias("kind")))
    none = F.array().cast("array<struct<start: int, end: int, kind: string>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        joins = (F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(named, none, add)


def masked(text: Column, entities: Column, least: float = LEAST_SCORE) -> Column:
    """A text with each merged span of its entities replaced by [KIND]; spans beyond its end don't count."""
    inside = F.filter(entities, lambda e: e["end"] <= F.length(text))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))
    return F.aggregate(merged(inside, least), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def analyzed(text: Column, kinds: tuple[str, ...] = KINDS, least: float = LEAST_SCORE, surnames: tuple[str, ...] = SURNAMES) -> Column:
    """Entities of a text: found in its normalized form, in its own places, of the least score or more, scores to four digits.

    The same as ``remapped`` of ``found`` over ``normalize``, in one pass of Python.
    """
    family, context = _patterns(surnames)

    @F.arrow_udf(SPAN)
    def run(texts: pa.Array) -> pa.Array:
        a, b = re.compile(family), re.compile(context)

        def one(t: str | None) -> list[dict]:
            form, pieces = normalized(t or "")
            starts = [p[0] for p in pieces]
            back = lambda place: place + pieces[bisect.bisect_right(starts, place) - 1][1]
            return [e | {"start": back(e["start"]), "end": back(e["end"]), "score": round(e["score"], 4)} for e in find(form, kinds, a, b) if e["score"] >= least]

        return few_at_a_time(texts, one, ARROW_SPAN)

    return run(text)


def replaced(text: str, entities: list[dict], least: float = LEAST_SCORE) -> str:
    """``masked`` of a text at hand."""
    good = sorted((e for e in entities if e["score"] >= least and e["start"] < e["end"] <= len(text)), key=lambda e: (e["start"], -e["end"]))
    out, at, reach = [], 0, 0
    for e in good:
        if e["start"] >= reach:
            out += [text[at : e["start"]], f"[{e['kind']}]"]
        reach = at = max(reach, e["end"])
    return "".join([*out, text[at:]])
