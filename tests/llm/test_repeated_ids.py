"""Rows that repeat an id span chunks and tasks, with the results of one chunk."""

import random

from chronolake.llm import chunks, substring_dedup, suffix_dedup


def test_one_id_holds_most_rows(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{rng.random()}" for _ in range(30))
    texts = [" ".join(f"{rng.random()}" for _ in range(5_000)) + " " + passage for _ in range(40)]
    held = [(None, t) for t in texts] + [(1, "a " + passage), (2, "b " + passage + " c"), (2, passage)]
    docs = spark.createDataFrame(held, "doc_id long, text string")
    packed = chunks.pack_chunks(docs).collect()
    rows = [r for r in packed if None in r["ids"]]
    assert len(rows) > 3 and len({r["chunk"] >> 32 for r in rows}) > 1 and all(set(r["ids"]) == {None} for r in rows)
    assert sum(len(r["ids"]) for r in packed) == len(held)
    cut = suffix_dedup.repeated_bytes(docs).collect()
    assert all((r["n_removed"] == 0) == (r["doc_id"] is None) for r in cut)
    left = substring_dedup.repeated_windows(docs).collect()
    assert sorted(r["n_removed"] for r in left) == [0] + [30] * 42


def test_null_and_first_id_are_different_heads(spark):
    passage = "x".join(str(i) for i in range(200))
    docs = spark.createDataFrame([(None, passage), (None, passage), (5, passage), (5, passage)], "doc_id long, text string")
    cut = suffix_dedup.repeated_bytes(docs).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in cut) == [(False, len(passage))] * 2 + [(True, 0)] * 2
