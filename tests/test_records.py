"""Ledger transitions, title rules and JSON redaction at their edges."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from chronolake.functions import dates, privacy, text
from chronolake.operators import ledger


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_json_leaves_are_values_only(spark):
    j = json.dumps({"password": 1, "a": {"b": ['say "hi": there', "end:"]}, "n": None, "e": ""})
    assert one(spark, privacy.leaves, j) == ['"say \\"hi\\": there"', '"end:"', '""']
    assert not one(spark, lambda x: privacy.json_contains(x, ["password"]), j)
    assert one(spark, lambda x: privacy.json_contains(x, ["THERE"]), j)
    assert one(spark, lambda x: privacy.json_contains(x, ["there"]), None) is False


def test_json_masked_keeps_keys(spark):
    j = json.dumps({"there": ["there", {"x": "over there, there"}], "n": 3})
    out = json.loads(one(spark, lambda x: privacy.json_masked(x, ["there"]), j))
    assert out == {"there": ["█████", {"x": "over █████, █████"}], "n": 3}


@pytest.mark.parametrize(("url", "want"), [("a%20b+c", "a b+c"), ("100%", "100%"), ("%zz%41", "%zzA"), ("", ""), (None, None)])
def test_percent_decoded(spark, url, want):
    assert one(spark, text.percent_decoded, url) == want


@pytest.mark.parametrize(("title", "process", "site", "want"), [
    ("me/tool: fix it", "chrome.exe", "", "tool"),
    ("Pull requests · example/paper - GitHub", "chrome.exe", "GitHub", "paper"),
    ("main.jsx - paper - Visual Studio Code", "Code.exe", "", "paper"),
    ("main.py - tool - Cursor", "cursor.exe", "", "tool"),
    ("Some page | Site", "chrome.exe", "", "Site"),
    ("Some page - Google Chrome", "chrome.exe", "", "Some page"),
    ("Docs | Site - Google Chrome", "chrome.exe", "", "Site"),
    ("Notes  for\tme - notes", "notes.exe", "", "Notes for me"),
    ("x" * 70, None, None, "x" * 61 + "..."),
    ("a (b) - C++", "x.exe", "C++", "a (b)"),
    (None, None, None, None),
])
def test_title_entity(spark, title, process, site, want):
    assert one(spark, lambda t: text.title_entity(t, F.lit(process).cast("string"), F.lit(site).cast("string")), title) == want


@pytest.mark.parametrize(("value", "want"), [("", 0.0), ("a", 0.0), ("https://a.bc", 0.0)])
def test_title_score_zero(spark, value, want):
    assert one(spark, text.title_score, value) == want


def test_short_natural_titles_beat_numbers(spark):
    assert one(spark, text.title_score, "Rising Tempo") > one(spark, text.title_score, "1:02") >= 0


def test_retry_time(spark):
    assert one(spark, dates.retry_time, "2024-01-02T03:04:05.6+02:00") == "2024-01-02 01:04:05"
    assert one(spark, dates.retry_time, "2024-01-02 03:04:05") == "2024-01-02 03:04:05"
    assert one(spark, dates.retry_time, None) is None
    with pytest.raises(Exception, match="RFC 3339"):
        one(spark, dates.retry_time, "tomorrow")


def test_generation_refuses_mixed_widths_and_ignores_order(spark):
    rows = [(str(i), 4, "m", f"p{i}") for i in range(50)]
    cols = "subject_key string, dims int, model_id string, payload string"
    a = ledger.generation(spark.createDataFrame(rows, cols), 1).first()
    assert a == ledger.generation(spark.createDataFrame(rows[::-1], cols), 1).first()
    assert a["checksum"] != ledger.generation(spark.createDataFrame([*rows[1:], ("0", 4, "m", "other")], cols), 1).first()["checksum"]
    assert ledger.generation(spark.createDataFrame([], cols), 1).first()["checksum"] == hashlib.sha256(b"").hexdigest()
    with pytest.raises(Exception, match="mixed"):
        ledger.generation(spark.createDataFrame([*rows, ("x", 5, "m", "p")], cols), 1).collect()


def test_of_equal_new_rows_the_first_is_pending(spark):
    cols = "id long, image_hash string, is_deleted boolean"
    old = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "a", None)], cols)
    new = spark.createDataFrame([(10, "c", None), (11, "c", None), (12, "a", None), (13, "b", None), (14, "b", None), (15, None, None)], cols)
    got = {r["id"]: (r["status"], r["duplicate_of"]) for r in ledger.pending_insert(old, new).collect()}
    assert got == {10: ("pending", None), 11: ("duplicate", 10), 12: ("duplicate", 1), 13: ("pending", None), 14: ("duplicate", 13), 15: ("pending", None)}


def test_soft_deleted_rows_keep_no_hash_alive(spark):
    rows = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "b", False), (4, "b", False)], "id long, image_hash string, is_deleted boolean")
    ids, hashes = ledger.cascade(rows, spark.createDataFrame([(1,), (3,)], "id long"))
    assert sorted(r[0] for r in ids.collect()) == [1, 3] and [r[0] for r in hashes.collect()] == ["a"]


def test_a_group_can_be_replaced_by_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "g int, v string")
    got = ledger.replaced(old, old.filter("false"), spark.createDataFrame([(2,)], "g int"), "g").collect()
    assert [tuple(r) for r in got] == [(1, "a")]


def test_epochs_move_only_where_the_visible_set_does(spark):
    cols = "kind string, subject_key string, fingerprint string"
    a = spark.createDataFrame([("t", "1", "x"), ("t", "2", "y"), ("i", "1", "z")], cols)
    b = spark.createDataFrame([("t", "2", "y"), ("t", "1", "w"), ("i", "1", "z")], cols)
    e = spark.createDataFrame([("t", 4), ("i", 4)], "kind string, epoch int")
    assert {tuple(r) for r in ledger.next_epochs(e, a, b).collect()} == {("t", 5), ("i", 4)}
