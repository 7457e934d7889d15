"""Lines at the borders of ranges, headers anywhere at the top, and files that grow."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chronolake.sources import line_files as lf


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_each_line_once_at_any_border(tmp_path, size):
    rng = random.Random(size)
    body = "".join(rng.choice(["", "a", "bcd", "é漢", "x" * 20]) + rng.choice(["\n", "\r\n"]) for _ in range(40)) + rng.choice(["", "last"])
    p = tmp_path / "f"
    p.write_bytes(body.encode())
    got = [x for r in lf.ranges(str(p), 0, p.stat().st_size, size) for x in lf.lines(r)]
    want, at = [], 0
    for line in body.encode().split(b"\n")[: None if not body.endswith("\n") else -1]:
        want.append((at, line.rstrip(b"\r")))
        at += len(line) + 1
    assert got == want


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_header_below_blank_lines(spark, tmp_path, sep):
    rows = [["p" + str(i), str(i), f"path {i}"] for i in range(50)]
    top = "﻿" if sep == "," else ""
    (tmp_path / "a.csv").write_text(top + "\n" + sep * 2 + "\n" + sep.join(["Process Name", "Event ID", "File Path"]) + "\n" + "\n".join(map(sep.join, rows)) + "\n\n")
    (tmp_path / "b.csv").write_text(sep.join(["path", "extra", "process-name", "size"]) + "\n" + sep.join(['"q"', "1", "r", "9"]) + "\nshort\n")
    (tmp_path / "_c.csv").write_text("hidden")
    (tmp_path / "d.csv").write_text("\n\n")
    wanted = {"process": ["processname"], "bytes": ["size"], "path": ["filepath"]}
    for size in (40, 1 << 20):
        got = lf.read_event_csv(spark, f"file://{tmp_path}", wanted, size)
        assert got.columns == ["process", "bytes", "path"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(r[0], None, r[2]) for r in rows] + [("r", "9", "q"), (None, None, "short")], key=str)


def test_no_files(spark, tmp_path):
    assert lf.read_event_csv(spark, str(tmp_path), {"a": []}).count() == 0
    assert lf.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0


def test_json_lines_are_appended_and_read(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(i, f"é{i}\n", [i, 2]) for i in range(20)], "b long, a string, c array<long>")
    lf.append_jsonl(df.repartition(3), out)
    lf.append_jsonl(df.limit(1), out)
    back = lf.read_jsonl(spark, out, "a string, b long, c array<long>", range_bytes=50)
    assert sorted(map(tuple, back.select("b", "a", "c").collect())) == sorted([*map(tuple, df.collect()), tuple(df.first())])
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.jsonl"))
    assert text.isascii() and text.startswith('{"a": "\\u00e9') and not list((tmp_path / "out").glob(".*part*"))


def test_a_failed_write_shows_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    bad = spark.range(10, numPartitions=2).select("id", F.when(F.col("id") == 9, F.raise_error(F.lit("stop"))).alias("x"))
    with pytest.raises(Exception, match="stop"):
        lf.append_jsonl(bad, out)
    assert lf.read_jsonl(spark, out, "id long").count() == 0


def test_a_growing_file_as_a_stream(spark, tmp_path):
    src, out, cp = tmp_path / "src", f"{tmp_path}/out", f"{tmp_path}/cp"
    src.mkdir()

    def run():
        rows = lf.read_jsonl(spark, str(src), "i long", stream=True, range_bytes=16)
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["i"] for r in spark.read.schema("i long").parquet(out).collect())

    line = lambda i: json.dumps({"i": i}) + "\n"
    (src / "a").write_text(line(0) + line(1) + '{"i"')
    assert run() == [0, 1]
    # The rest of a line that was not whole, more lines, another file.
    with (src / "a").open("a") as f:
        f.write(": 2}\n" + line(3))
    (src / "b").write_text("".join(map(line, range(10, 20))))
    assert run() == [0, 1, 2, 3, *range(10, 20)]
    assert run() == [0, 1, 2, 3, *range(10, 20)]
