"""Word lists as automata, and spans of personal data."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from chronolake.functions import privacy, spans, words


def column(spark, f, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_dictionary_examples(spark):
    known = ["secret", "password"]
    assert column(spark, lambda x: words.contains(x, known), "my secret data", "hello world", "MY SECRET DATA", "", None) == [True, False, True, False, False]
    assert column(spark, lambda x: words.contains(x, ["a", "ab", "abc"]), "a", "ab") == [False, True]
    assert column(spark, lambda x: words.masked(x, known), "my Secret data", None) == ["my ██████ data", None]
    assert column(spark, lambda x: words.contains(x, []), "abc") == [False]
    # Upper-case letters beyond ASCII differ from their lower-case ones.
    assert column(spark, lambda x: words.contains(x, ["été"]), "un été", "UN ÉTÉ") == [True, False]


def test_longest_equals_the_pattern_and_first_ending_the_stops():
    rng = random.Random(8)
    for _ in range(300):
        own = ["".join(rng.choice("abB") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
        text = "".join(rng.choice("abAcé") for _ in range(30))
        pattern = re.compile(privacy.word_pattern(list({w.lower() for w in own})), re.A)
        assert words.matches(text, tuple(own)) == [m.span() for m in pattern.finditer(text)], (own, text)
        low, out, at = [w.lower() for w in own if len(w) > 1], [], 0
        while True:
            ends = [(e, s) for e in range(at + 1, len(text) + 1) for s in range(at, e) if text[s:e].lower() in low]
            if not ends:
                break
            e = min(ends)[0]
            out.append((min(s for x, s in ends if x == e), e))
            at = e
        assert words.matches(text, tuple(own), True) == out, (own, text)


def test_long_lists_equal_short_ones(spark):
    many = [f"word{i}x" for i in range(5000)] + ["secret", "a(b"]
    texts = ["a SECRET word12x word12y", "nothing", "A(B word4999xword0x", None]
    assert column(spark, lambda x: privacy.masked(x, many), *texts) == ["a ██████ ███████ word12y", "nothing", "███ " + "█" * 15, None]
    assert column(spark, lambda x: privacy.contains_any(x, many), *texts) == [True, False, True, False]
    j = json.dumps({"secret": ["my secret", {"word1x": 'a "word1x" é'}], "n": 3})
    want = {"secret": ["my ██████", {"word1x": 'a "██████" é'}], "n": 3}
    for known in (many, ["secret", "word1x"]):
        assert json.loads(column(spark, lambda x, k=known: privacy.json_masked(x, k), json.dumps(json.loads(j), ensure_ascii=False))[0]) == want
        assert column(spark, lambda x, k=known: privacy.json_contains(x, k), j, json.dumps({"secret": 1}), None) == [True, False, False]


NORMAL = [("０１２３４５６７８９", "0123456789"), ("32011 2750915342", "320112750915342"), ("147 28087-589", "14728087589"), ("123 - 456", "123456"), ("hello world 123", "hello world 123"), (" 123 abc ", " 123 abc "), ("1–2—3", "123"), ("1 -a", "1 -a"), ("", "")]


@pytest.mark.parametrize(("text", "want"), NORMAL)
def test_normalized(text, want):
    assert spans.normalized(text)[0] == want


def full_map(text, pieces, n):
    return [p + max((x for x in pieces if x[0] <= p))[1] for p in range(n + 1)]


def test_map_leads_back():
    assert full_map("1 2", spans.normalized("1 2")[1], 2) == [0, 2, 3]
    assert full_map("abc123", spans.normalized("abc123")[1], 6) == list(range(7))
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("12a -–") for _ in range(20))
        norm, pieces = spans.normalized(text)
        back = full_map(text, pieces, len(norm))
        assert [text[i] for i in back[:-1]] == list(norm) and back[-1] == len(text) and back == sorted(back)


def test_normalize_column(spark):
    got = column(spark, spans.normalize, "1 2", None)
    assert got[0]["text"] == "12" and [tuple(p) for p in got[0]["pieces"]] == [(0, 0), (1, 1)] and got[1] is None
    assert column(spark, privacy.normalize_digits, *[t for t, _ in NORMAL]) == [w for _, w in NORMAL]


NOISY = "我是张凯文的爸爸，sfz号码32011 2750915342，电话号码147 28087-589。卡4111 1111 1111 1111!"


def test_analyzed_in_places_of_the_text(spark):
    got = {(e["kind"], NOISY[e["start"] : e["end"]]) for e in column(spark, spans.analyzed, NOISY)[0]}
    assert got >= {("ID_CARD_15", "32011 2750915342"), ("MOBILE", "147 28087-589"), ("BANK_CARD", "4111 1111 1111 1111")}
    assert column(spark, spans.analyzed, None, "", "none here") == [[], [], []]
    assert column(spark, lambda x: spans.analyzed(x, ("ID_CARD", "ID_CARD_15", "BANK_CARD", "LANDLINE")), "320112751315342", "320112750932342", "4111111111111112", "021-12345678, 010 1234567") == [
        [], [], [], [("LANDLINE", 0, 12, 0.3), ("LANDLINE", 14, 25, 0.3)]]
    assert spans.id_card("11010119900307002X") == bool(spans.ID_CHECKS[sum(int(c) * w for c, w in zip("11010119900307002", spans.ID_WEIGHTS, strict=True)) % 11] == "X")


def test_remapped_spans_equal_those_of_one_pass(spark):
    texts = [NOISY, "a 1 2", "", "021-1234 5678 x@y.zz １３８ 0013 8000"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    form = df.withColumn("form", spans.normalize(F.col("x"))).withColumn("e", spans.found(F.col("form.text")))
    got = {r["i"]: [tuple(e) for e in r["y"]] for r in form.select("i", spans.remapped(F.col("e"), F.col("form.pieces")).alias("y")).collect()}
    assert got == {i: [tuple(e) for e in y] for i, y in enumerate(column(spark, spans.analyzed, *texts))} and got[3]


def people(text, surnames=spans.SURNAMES):
    family = re.compile("|".join(sorted(surnames, key=lambda x: (-len(x), x))))
    context = re.compile(f"(?=({'|'.join(sorted(spans.NAME_CONTEXT, key=len))}))")
    return {text[a:b] for a, b in spans.names(text, family, context)}


def test_names_need_a_context_word():
    assert "谭辉" in people("用户名谭辉)已注册")
    assert {"劳荣枝", "沈凌秋"} <= people("犯罪嫌疑人劳荣枝使用化名为沈凌秋的身份证")
    assert "徐淼" in people("被告人徐淼到庭") and people("今天天气不错") == set()
    assert "欧阳修" in people("欧阳修先生") and "阳修" not in people("欧阳修先生")
    # Ten characters on either side, the whole word within.
    assert people("王明" + "x" * 8 + "先生") and people("王明" + "x" * 7 + "先生，") and not people("王明" + "x" * 9 + "先生")
    assert people("先生" + "x" * 8 + "王明") and not people("先生" + "x" * 9 + "王明")


def test_addresses_equal_the_pattern():
    cjk, any_of = "[\u4e00-\u9fff]", lambda x: f"(?:{'|'.join(x)})"
    pattern = re.compile(f"{cjk}{{2,}}{any_of(spans.PROVINCE_ENDS)}{cjk}{{2,}}{any_of(spans.CITY_ENDS)}{cjk}{{2,}}{any_of(spans.DISTRICT_ENDS)}(?:[\u4e00-\u9fff0-9]+{any_of(spans.STREET_ENDS)})*")
    assert list(spans.addresses("住江苏省南京市江宁区天元路12号，")) == [(0, 16)]
    rng = random.Random(6)
    hits = 0
    for _ in range(3000):
        text = "".join(rng.choice(["省", "市", "区", "县", "江", "苏", "路", "号", "单元", "自治区", "1", "x", "地区", "明", "天"]) for _ in range(rng.randint(8, 30)))
        want = [m.span() for m in pattern.finditer(text)]
        assert list(spans.addresses(text)) == want, text
        hits += bool(want)
    assert hits > 100
    assert list(spans.addresses("省市区" * 20_000 + "x")) == [(0, 60_000)]


def plain_mask(text, entities):
    good = sorted((e for e in entities if e[3] >= 0.3 and e[1] < e[2] <= len(text)), key=lambda e: (e[1], -e[2]))
    out, at, last = "", 0, None
    joined = []
    for kind, a, b, _ in good:
        if joined and a < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], b)
        else:
            joined.append([kind, a, b])
    for kind, a, b in joined:
        out += text[at:a] + f"[{kind}]"
        at = b
    return out + text[at:]


def test_masks_of_overlapping_spans(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abc漢é") for _ in range(20))
        ents = [(rng.choice("XYZ"), a := rng.randrange(22), a + rng.randrange(6), rng.choice([0.2, 0.3, 0.9])) for _ in range(rng.randrange(6))]
        rows.append((i, text, ents))
    df = spark.createDataFrame(rows, f"i int, x string, e {spans.SPAN}")
    got = {r["i"]: r["y"] for r in df.select("i", spans.masked(F.col("x"), F.col("e")).alias("y")).collect()}
    assert got == {i: plain_mask(text, ents) for i, text, ents in rows}


def test_replaced_equals_masked():
    rng = random.Random(12)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(15))
        ents = [(rng.choice("XYZ"), a := rng.randrange(16), a + rng.randrange(5), rng.choice([0.2, 0.3, 0.9])) for _ in range(rng.randrange(6))]
        assert spans.replaced(text, [dict(zip(("kind", "start", "end", "score"), e, strict=True)) for e in ents]) == plain_mask(text, ents)


def test_records_under_each_mode(spark):
    from chronolake.operators import redaction as rd

    kind = "id int, title string, url string, links array<struct<url: string, text: string>>, boxes array<string>"
    rows = [(1, "ok", "http://a/%73ecret", [("u", "the Secret"), ("v", "fine")], ["a", "my secret", None]), (2, None, None, None, None), (3, "secret", "http://b", [("u", "secret")], []), (4, "call 138 0013-8000", "http://b", [], ["x@y.zz"])]
    df = spark.createDataFrame(rows, kind)
    tier = rd.Words(("secret",))
    out = lambda t, m: {r["id"]: (r["title"], r["url"], r["links"] and [tuple(x) for x in r["links"]], r["boxes"]) for r in rd.redacted_records(df, t, m).collect()}
    assert set(out(tier, "reject")) == {2, 4}
    c = "[censored]"
    assert out(tier, "remove_paragraph") == {1: ("ok", c, [("v", "fine")], ["a", None]), 2: (None, None, None, None), 3: (c, "http://b", None, []), 4: (rows[3][1], "http://b", None, ["x@y.zz"])}
    assert out(tier, "mask") == {1: ("ok", c, [("u", "the ██████"), ("v", "fine")], ["a", "my ██████", None]), 2: (None, None, None, None), 3: ("██████", "http://b", [("u", "██████")], []), 4: (rows[3][1], "http://b", None, ["x@y.zz"])}
    assert out(rd.Entities(), "mask")[4] == ("call [MOBILE]", "http://b", None, ["[EMAIL]"]) and set(out(rd.Entities(), "reject")) == {1, 2, 3}
    with pytest.raises(ValueError):
        rd.redacted_records(df, tier, "other")
