"""Small cases of operators whose results are known by hand."""

import datetime as d

from pyspark.sql import functions as F

from chronolake.functions import dates, privacy, text, vector
from chronolake.operators import lifecycle, relations, search, telemetry, text_assembly, timeline
from chronolake.streaming import frames, index


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_bigrams_keep_case_and_drop_signs(spark):
    assert one(spark, text.bigrams(F.lit("Ab-a 漢字"))) == ["Ab", "ba", "a漢", "漢字"]
    assert one(spark, text.bigrams(F.lit("a"))) == []
    assert one(spark, text.bigrams(F.lit("aaa"))) == ["aa"]


def test_hmac(spark):
    import hashlib
    import hmac

    assert one(spark, text.hmac_sha256(F.lit("wörd"), b"k")) == hmac.new(b"k", "wörd".encode(), hashlib.sha256).hexdigest()


def test_entropy(spark):
    assert abs(one(spark, text.entropy(F.lit("aabb"))) - 1.0) < 1e-12
    assert one(spark, text.entropy(F.lit(""))) == 0.0


def test_lenient_int(spark):
    got = spark.createDataFrame([("0x1F",), ("1,234",), ("3.9",), ("",), ("abc",), (None,)], "s string").select(text.lenient_int(F.col("s")).alias("x"))
    assert [r["x"] for r in got.collect()] == [31, 1234, 3, None, None, None]


def test_float_list(spark):
    assert one(spark, text.float_list(F.lit("1, 2.5,,"))) == [1.0, 2.5]
    assert one(spark, text.float_list(F.lit(""))) == [1.0, 1.5, 2.0]


def test_threshold(spark):
    def t(p, n):
        return one(spark, vector.threshold(F.array(*map(F.lit, p)).cast("array<double>"), F.array(*map(F.lit, n)).cast("array<double>")))

    assert abs(t([4.0, 6.0], []) - 3.4) < 1e-9
    assert abs(t([4.0], [3.5]) - 3.675) < 1e-9
    assert abs(t([-1.0], [-2.0]) + 0.85) < 1e-9
    assert t([], [1.0]) is None
    assert t([float("nan")], []) is None


def test_cards(spark):
    assert one(spark, privacy.luhn(F.lit("4111111111111111"))) is True
    assert one(spark, privacy.luhn(F.lit("4111111111111112"))) is False
    assert one(spark, privacy.luhn(F.lit("411111"))) is False
    assert one(spark, privacy.id_card_15(F.lit("320112750915342"))) is True
    assert one(spark, privacy.id_card_15(F.lit("320112751315342"))) is False
    assert one(spark, privacy.id_card(F.lit("11010519491231002X"))) is True
    assert one(spark, privacy.id_card(F.lit("110105194912310021"))) is False


def test_masks(spark):
    assert one(spark, privacy.masked(F.lit("my Secret data"), ["secret", "password"])) == "my ██████ data"
    assert one(spark, privacy.contains_any(F.lit("MY SECRET DATA"), ["secret"])) is True
    assert one(spark, privacy.contains_any(F.lit("a"), ["a", "ab"])) is False
    assert one(spark, privacy.normalize_digits(F.lit("１２ 3-4 x"))) == "1234 x"


def test_phones(spark):
    found = one(spark, F.transform(privacy.entities(F.lit("call 13800138000 now")), lambda e: e["kind"]))
    assert found == ["MOBILE"]


def test_dates(spark):
    assert one(spark, dates.seconds(F.lit(1.7e12))) == 1.7e9
    assert one(spark, dates.known(F.lit(0))) is None
    assert one(spark, dates.limit_bytes(F.lit("unlimited"))) is None
    assert one(spark, dates.limit_bytes(F.lit("2"))) == 2 << 30


def test_retry(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 99)], "a int")
    s, w = lifecycle.retry(F.col("a"))
    got = [tuple(r) for r in rows.select(s, w).collect()]
    assert got == [("pending", 30), ("pending", 60), ("pending", 120), ("pending", 300), ("failed", None), ("failed", None)]


def test_text_prefix_is_a_prefix_of_the_full_text(spark):
    rows = spark.createDataFrame([(1, 1, "0123456789"), (1, 2, None), (1, 3, ""), (1, 4, "abcdefghij"), (1, 5, "tail"), (2, 6, "短文本"), (4, 7, "")], "p int, i int, text string")
    full = dict(map(tuple, text_assembly.joined_text(rows, "p", ["i"]).collect()))
    part = dict(map(tuple, text_assembly.text_prefix(rows, "p", ["i"], 20).collect()))
    assert part[1] == "0123456789 abcdefghij" and full[1].startswith(part[1]) and part[2] == "短文本" and 4 not in part


def test_semi_join_counts_hashes_of_live_parents_with_children(spark):
    shots = spark.createDataFrame([(1, "h1", False), (2, "h1", False), (3, "h2", False), (4, "h3", False), (5, "h4", True), (6, "h5", False)], "id long, h string, is_deleted boolean")
    ocr = spark.createDataFrame([(i,) for i in (1, 1, 2, 3, 4, 5)], "parent_id long")
    live = timeline.live(shots)
    assert live.join(ocr, live["id"] == ocr["parent_id"], "left_semi").select("h").distinct().count() == 3


def test_backlog_counts_rows_in_backoff(spark):
    t = d.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([("1", "pending", 0, None, t), ("2", "processing", 0, None, t), ("3", "failed", 1, t, t), ("4", "failed", 1, d.datetime(9999, 12, 31), t)], "subject_key string, status string, attempts int, next_retry_at timestamp, updated_at timestamp")
    now = F.lit(t)
    assert [r["subject_key"] for r in relations.claimable_jobs(jobs, 5, now, 10).collect()] == ["1", "3"]
    assert [r["subject_key"] for r in relations.claimable_jobs(jobs, 1, now, 10).collect()] == ["1"]
    assert tuple(relations.backlog(jobs, 1, F.lit(0)).first())[:2] == (1, 2)
    assert tuple(relations.backlog(jobs, 5, F.lit(0)).first())[:2] == (3, 0)


def test_search_pages_may_be_short_and_strict_needs_all_tokens(spark):
    rows = spark.createDataFrame([(1, 10, "hello world", "a", "p1", 1), (2, 10, "hell", "a", "p2", 2), (3, 11, "help wor", "b", "p1", 3)], "id long, parent_id long, text string, category string, process_name string, created_at long")
    ix = search.postings(rows)
    ids = lambda q, **k: [r["id"] for r in search.search(rows, ix, q, **k).collect()]
    assert ids("hello") == [1]
    assert ids("hello", fuzzy=True) == [1, 2, 3]
    assert ids("hell", processes=["p1"], limit=1) == []
    assert ids("hello world") == [2]
    assert ids("h") == [] and ids("") == [3, 2, 1]
    assert ids("hellzz", fuzzy=True) == [2, 1, 3] and ids("hellzz") == []


def test_descendants_survive_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "parent long, id long")
    got = telemetry.descendants(edges, spark.createDataFrame([(1,)], "id long"))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3]


def test_frames_are_compared_with_kept_ones_only(spark):
    far = (1 << 40) - 1
    rows = spark.createDataFrame([(1, 1, [0]), (1, 2, [0b111111111]), (1, 3, [0b11111111111]), (1, 4, [far]), (2, 5, [0])], "s int, t int, h array<long>")
    got = frames.suppress_redundant(rows, "s", ["t"], "h")
    assert sorted(r["t"] for r in got.collect()) == [1, 3, 4, 5]


def test_index_picks_up_what_is_new(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.createDataFrame([(1, "abc")], "id long, text string").write.parquet(src)
    index.build_index(spark, src, "id long, text string", out, cp)
    spark.createDataFrame([(2, "bcd")], "id long, text string").write.mode("append").parquet(src)
    index.build_index(spark, src, "id long, text string", out, cp)
    got = sorted(tuple(r) for r in index.read_index(spark, out).collect())
    assert got == [("ab", 1), ("bc", 1), ("bc", 2), ("cd", 2)]


def test_vectors_are_packed_and_checked(spark):
    import pytest

    from chronolake.sources import logs

    good = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<float>")
    assert logs.decode_vectors(logs.encode_vectors(good)).first()["vector"] == [1.0, 2.0]
    for bad in ([0.0, 0.0], [float("nan")], []):
        with pytest.raises(Exception, match="vector"):
            logs.encode_vectors(spark.createDataFrame([(1, bad)], "id long, vector array<float>")).collect()


def test_counter_deltas_never_fall(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 9.0), (1, 3, 2.0)], "p int, t int, v double")
    assert sorted(r["delta"] for r in telemetry.counter_deltas(rows, "p", ["t"], "v").collect()) == [0.0, 0.0, 4.0]


def test_row_numbers_are_gapless_beside_a_payload(spark):
    from pyspark.sql import functions as F

    from chronolake.operators.timeline import row_numbers

    df = spark.range(0, 1_000_000, 1, 8).select((F.xxhash64("id") % 1_000_000_007).alias("at"), "id", F.repeat(F.lit("payload "), 3).alias("body"))
    got = row_numbers(df, ["at", "id"]).agg(F.count_distinct("_row").alias("n"), F.min("_row").alias("low"), F.max("_row").alias("high")).first()
    assert tuple(got) == (1_000_000, 0, 999_999)


def test_neighbouring_numbers_are_all_found(spark):
    from pyspark.sql import functions as F

    from chronolake.functions import privacy

    df = spark.createDataFrame([("13800138000 13900139000,13700137000x",), ("no entity at all",), (None,)], "text string")
    found = [[e["value"] for e in r["e"]] for r in df.select(privacy.entities(F.col("text")).alias("e")).collect()]
    assert found == [["13800138000", "13900139000", "13700137000"], [], []]


def test_bigrams_of_characters_beyond_the_first_plane(spark):
    from pyspark.sql import functions as F

    from chronolake.functions.text import bigrams

    texts = ["a\U00020000b\U00020001", "ab ab", "x", "", None]
    got = [r["b"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(bigrams(F.col("t")).alias("b")).collect()]
    assert got == [["a\U00020000", "\U00020000b", "b\U00020001"], ["ab", "ba"], [], [], []]
