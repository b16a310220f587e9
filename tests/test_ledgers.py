"""Ledgers that are followed: budgets, partial lines, restarts in mid-file."""

import json
import os

import pytest

from plumbline.sources.ledgers import LedgerReader, Ledgers


def put(folder, name, *lines, age=None, tail=""):
    with open(folder / name, "a") as f:
        f.write("".join(line + "\n" for line in lines) + tail)
    if age is not None:
        os.utime(folder / name, (1_700_000_000 + age,) * 2)


def event(n):
    return json.dumps({"n": n, "text": "é" * n})


def numbers(rows):
    return [json.loads(r[2])["n"] for r in rows]


def test_oldest_first_within_the_budget(tmp_path):
    put(tmp_path, "b.jsonl", event(1), "", "{broken", event(2), "[3]", age=5)
    put(tmp_path, "a.jsonl", event(4), event(5), age=9)
    put(tmp_path, "c.txt", event(6), age=1)
    reader, offset, seen, batches = LedgerReader(str(tmp_path), 3, "all"), {}, [], 0
    while True:
        rows, end = reader.read(offset)
        rows = list(rows)
        assert len(rows) <= 3 and sorted(rows) == sorted(reader.readBetweenOffsets(offset, end))
        if end == offset:
            break
        seen += numbers(rows)
        offset, batches = end, batches + 1
    assert seen == [1, 2, 4, 5] and batches == 2 and offset == {n: (tmp_path / n).stat().st_size for n in ("a.jsonl", "b.jsonl")}


def test_a_line_without_an_end_waits(tmp_path):
    put(tmp_path, "a.jsonl", event(1), tail=event(2)[:5])
    reader = LedgerReader(str(tmp_path), 10, "all")
    rows, offset = reader.read({})
    assert numbers(rows) == [1]
    put(tmp_path, "a.jsonl", event(2)[5:])
    rows, end = reader.read(offset)
    assert numbers(rows) == [2] and end["a.jsonl"] == (tmp_path / "a.jsonl").stat().st_size
    assert numbers(reader.read({"a.jsonl": 10**6})[0]) == [1, 2]  # the file was cut short


def test_newest_and_missing(tmp_path):
    put(tmp_path, "a.jsonl", event(1), age=9)
    put(tmp_path, "b.jsonl", event(2), age=5)
    assert numbers(LedgerReader(str(tmp_path), 10, "newest").read({})[0]) == [1]
    rows, end = LedgerReader(str(tmp_path / "none"), 10, "all").read({})
    assert list(rows) == [] and end == {}
    with pytest.raises(ValueError, match="follow"):
        LedgerReader(str(tmp_path), 10, "some")


def test_a_restart_in_mid_file_loses_and_repeats_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spark.dataSource.register(Ledgers)

    def run(batches=None):
        stream = spark.readStream.format("ledgers").option("path", str(folder)).option("budget", 4).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").start(f"{tmp_path}/out")
        query.processAllAvailable()
        query.stop()
        return sorted(numbers((None, None, r.event) for r in spark.read.parquet(f"{tmp_path}/out").collect()))

    put(folder, "a.jsonl", *(event(n) for n in range(6)), age=1)
    put(folder, "b.jsonl", *(event(n) for n in range(6, 9)), age=2, tail=event(9)[:4])
    assert run() == list(range(9))
    put(folder, "b.jsonl", event(9)[4:], event(10), age=3)
    put(folder, "a.jsonl", event(11), age=4)
    assert run() == list(range(12))
    assert run() == list(range(12))
