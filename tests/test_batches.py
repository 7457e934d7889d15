"""Texts come to Python a few at a time, whatever the batch."""

import pyarrow as pa

from chronolake.functions.spans import few_at_a_time
from chronolake.operators import redaction as rd


def test_results_of_slices_follow_each_other():
    got = few_at_a_time(pa.array(["a", None, "bb"] * 50), lambda t: len(t or ""), pa.int32(), 7)
    assert got.to_pylist() == [1, 0, 2] * 50 and len(few_at_a_time(pa.array([], pa.string()), len, pa.int32())) == 0


def test_masked_texts_come_back_in_mode_mask_only(spark):
    df = spark.createDataFrame([(["a secret", None, "b"],), (None,)], "t array<string>")
    tier = rd.Words(("secret",))
    for mode, masked in (("mask", "a ██████"), ("reject", None), ("remove_paragraph", None)):
        row = [r["v"] for r in df.select(rd.judged(df["t"], tier, mode).alias("v")).collect()]
        assert [x["hit"] for x in row[0]] == [True, False, False] and row[0][0]["masked"] == masked and not row[1]
