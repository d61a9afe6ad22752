"""Data sources and the log sink: damaged input as rows, pushed filters, resumed streams, tasks that die."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textmill.sources import datasource


@pytest.fixture
def folder(spark):
    datasource.register(spark)
    p = Path(f"/tmp/textmill-tests/source-{uuid.uuid4().hex}")
    p.mkdir(parents=True)
    return p


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_files_that_cannot_be_read_are_rows(spark, folder):
    (folder / "a.txt").write_text("plain é")
    (folder / "b.md").write_bytes(b"ok \xff broken")
    (folder / "c.png").write_bytes(b"\x89PNG")
    (folder / "README.md").write_text("about")
    (folder / "empty.txt").write_bytes(b"")
    (folder / "_hidden.txt").write_text("no")
    (folder / "long.txt").write_text("word " * 2_000_000)
    got = {r.name: (r.text, r.problem) for r in spark.read.format("corpus_files").load(str(folder)).collect()}
    assert got.pop("long.txt") == ("word " * 2_000_000, None)
    assert got == {"a.txt": ("plain é", None), "b.md": (None, "no UTF-8 at byte 3"), "c.png": (None, "unknown suffix"), "README.md": (None, "not a document"), "empty.txt": (None, "empty")}


def test_names_are_pushed_down(spark, folder):
    for i in range(5):
        (folder / f"{i}.txt").write_text(f"text {i}")
    df = spark.read.format("corpus_files").load(str(folder))
    assert rows(df.filter("name = '3.txt'").select("text")) == [("text 3",)]
    assert rows(df.filter("name in ('1.txt', '2.txt', 'x') and text like '%2'").select("name")) == [("2.txt",)]
    assert df.filter("name = 'none'").count() == 0 and df.filter("problem is null").count() == 5
    reader = datasource._CorpusReader(str(folder))
    left = list(reader.pushFilters([datasource.EqualTo(("name",), "3.txt"), datasource.EqualTo(("problem",), "x")]))
    assert len(left) == 1 and [p[0].rpartition("/")[2] for part in reader.partitions() for p in part.parts] == ["3.txt"]


def run(stream, folder, fmt="memory", **options):
    w = stream.writeStream.format(fmt).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True)
    for k, v in options.items():
        w = w.option(k, v)
    q = w.start()
    q.awaitTermination()


def test_streams_of_files_resume(spark, folder):
    out = f"{folder}-out"
    for step in range(3):
        (folder / f"{step}.txt").write_text(f"text {step}")
        run(spark.readStream.format("corpus_files").load(str(folder)), folder, "parquet", path=out)
    run(spark.readStream.format("corpus_files").load(str(folder)), folder, "parquet", path=out)
    assert rows(spark.read.parquet(out).select("name", "text")) == [(f"{i}.txt", f"text {i}") for i in range(3)]


def test_damaged_lines_are_rows(spark, folder):
    lines = [b'{"a": 1}', b"", b"no json", b"[1]", b'{"b": "\xc3\xa9"}', b'{"c": "\xff"}', b'{"last": true}']
    (folder / "log.jsonl").write_bytes(b"\n".join(lines))
    got = [(r.place, r.record, r.problem) for r in spark.read.format("jsonl_log").load(str(folder)).orderBy("place").collect()]
    place = lambda i: sum(len(x) + 1 for x in lines[:i])
    assert got == [(0, '{"a": 1}', None), (place(2), None, "no JSON"), (place(3), None, "no object"), (place(4), '{"b": "é"}', None), (place(5), None, "no UTF-8"), (place(6), '{"last": true}', None)]


def test_streams_of_lines_resume_within_files(spark, folder, monkeypatch):
    out, log = f"{folder}-out", folder / "log.jsonl"
    log.write_bytes(b'{"n": 0}\n{"n": 1}\n{"n":')  # the last line isn't whole yet
    run(spark.readStream.format("jsonl_log").load(str(folder)), folder, "parquet", path=out)
    assert rows(spark.read.parquet(out).select("record")) == [('{"n": 0}',), ('{"n": 1}',)]
    with log.open("ab") as f:
        f.write(b' 2}\nbad\n')
    (folder / "other.jsonl").write_bytes(b'{"n": 3}\n')
    run(spark.readStream.format("jsonl_log").load(str(folder)), folder, "parquet", path=out)
    assert rows(spark.read.parquet(out).select("record", "problem")) == sorted([('{"n": 0}', None), ('{"n": 1}', None), ('{"n": 2}', None), (None, "no JSON"), ('{"n": 3}', None)], key=str)


def test_written_lines_come_back(spark, folder):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit('é "'), "id")).alias("s")).repartition(4)
    df.write.format("jsonl_log").mode("append").save(str(folder))
    df.limit(10).write.format("jsonl_log").mode("append").save(str(folder))
    got = spark.read.format("jsonl_log").load(str(folder))
    assert got.filter("problem is not null").count() == 0 and got.count() == 1010
    parsed = got.select(F.from_json("record", "id long, s string").alias("r")).select("r.*").distinct()
    assert rows(parsed) == rows(df)
    df.limit(3).write.format("jsonl_log").mode("overwrite").save(str(folder))
    assert spark.read.format("jsonl_log").load(str(folder)).count() == 3


def test_a_task_that_dies_leaves_no_rows(spark, folder):
    spark.range(5).write.format("jsonl_log").mode("append").save(str(folder))
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception):
        bad.write.format("jsonl_log").mode("append").save(str(folder))
    assert spark.read.format("jsonl_log").load(str(folder)).count() == 5
    assert not list(folder.glob("_staged/*/*"))


def test_a_batch_written_again_replaces_itself(spark, folder):
    src = Path(f"{folder}-in")
    src.mkdir()
    (src / "a.txt").write_text("one")
    stream = lambda: spark.readStream.format("corpus_files").load(str(src)).select("name", "text")
    run(stream(), folder, "jsonl_log", path=str(folder))
    (src / "b.txt").write_text("two")
    run(stream(), folder, "jsonl_log", path=str(folder))
    read = lambda: sorted(json.loads(r.record)["name"] for r in spark.read.format("jsonl_log").load(str(folder)).collect())
    assert read() == ["a.txt", "b.txt"]
    writer = datasource._LogStreamWriter(str(folder), spark.read.format("corpus_files").load(str(src)).select("name", "text").schema, False)
    writer.commit([writer.write(iter([("b.txt", "two")]))], 1)
    assert read() == ["a.txt", "b.txt"]
    writer.abort([writer.write(iter([("c.txt", "x")]))], 2)
    assert read() == ["a.txt", "b.txt"]
