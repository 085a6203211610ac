"""Numbered lines and digests by byte ranges against plain reading."""

import gzip
import hashlib
import random

import pytest

from lexmill.sources import jsonl, ranges

SOME = ["", "a", "日本", "x" * 50, " ", "b\tc", "é"]


def content(seed, ends):
    rnd = random.Random(seed)
    return "".join(rnd.choice(SOME) + rnd.choice(ends) for _ in range(60)) + rnd.choice(["", "last"])


@pytest.mark.parametrize("ends", [["\n"], ["\r\n"], ["\r"], ["\n", "\r\n", "\r"]])
@pytest.mark.parametrize("block", [3, 1 << 20])
def test_every_range_has_its_lines(tmp_path, monkeypatch, ends, block):
    monkeypatch.setattr(ranges, "BLOCK", block)
    for seed in range(6):
        data = content(seed, ends).encode()
        path = tmp_path / f"{seed}"
        path.write_bytes(data)
        for split in (1, 2, 7, 64, 10_000):
            parts = [ranges.Range(str(path), s, min(len(data), s + split)) for s in range(0, len(data), split)]
            got = [[x for some in ranges.range_lines(p) for x in some] for p in parts]
            assert [x for g in got for x in g] == data.splitlines(), (seed, split)
            assert [ranges.first_lines(p) for p in parts] == [len(g) for g in got], (seed, split)


def test_lines_of_several_files(spark, tmp_path):
    want = []
    for k in range(3):
        data = "﻿" * (k == 1) + content(k, ["\n", "\r\n"])
        (tmp_path / f"f{k}.jsonl").write_bytes(data.encode())
        want += [(f"f{k}.jsonl", i, x) for i, x in enumerate(data.lstrip("﻿").encode().splitlines(), 1)]
    packed = content(9, ["\n"])
    (tmp_path / "g.jsonl.gz").write_bytes(gzip.compress(packed.encode()))
    want += [("g.jsonl.gz", i, x) for i, x in enumerate(packed.encode().splitlines(), 1)]
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"x\n")
    df = jsonl.lines(spark, f"file:{tmp_path}", split=100)
    got = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.value.encode()) for r in df.collect())
    assert got == sorted(want) and df.rdd.getNumPartitions() > 5
    assert "Exchange" not in df._jdf.queryExecution().toString()
    by_spark = jsonl._spark_lines(spark, f"{tmp_path}/*.jsonl").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.line_no, r.value.encode()) for r in by_spark) == sorted(w for w in want if not w[0].endswith("gz"))


def test_digests(spark, tmp_path):
    data = content(4, ["\n"]).encode()
    (tmp_path / "a").write_bytes(data)
    (tmp_path / "b.gz").write_bytes(gzip.compress(data))
    (tmp_path / "c").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: tuple(r[1:]) for r in jsonl.manifest(spark, [str(tmp_path)]).collect()}
    for name, n in (("a", len(data.splitlines())), ("b.gz", len(data.splitlines())), ("c", 0)):
        raw = (tmp_path / name).read_bytes()
        assert got[name] == (len(raw), hashlib.sha256(raw).hexdigest(), n)
    with pytest.raises(FileNotFoundError):
        jsonl.manifest(spark, [str(tmp_path / "none")])


def test_a_file_above_two_gigabytes_has_its_digest(spark, tmp_path):
    size = (3 << 30) + 5
    with open(tmp_path / "sparse", "wb") as f:
        f.truncate(size)
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size >> 24):
        digest.update(zeros)
    digest.update(bytes(size & ((1 << 24) - 1)))
    assert tuple(jsonl.manifest(spark, [str(tmp_path / "sparse")]).first()[1:]) == (size, digest.hexdigest(), 1)


def test_a_folder_of_files_counts_as_one(spark, tmp_path):
    parts = [content(k, ["\n"]).encode().removesuffix(b"last").rstrip(b"\n") + b"\n" for k in range(4)] + [b""]
    for k, data in enumerate(parts):
        (tmp_path / f"part-0000{k}.txt").write_bytes(data)
    whole = b"".join(parts)
    want = [(i, x) for i, x in enumerate(whole.splitlines(), 1)]
    known = ranges.listing([str(tmp_path)])
    for df in (jsonl.lines(spark, str(tmp_path), split=100, across=True), ranges.numbered(spark, known, 1 << 20, across=True), jsonl._spark_lines(spark, f"{tmp_path}/*.txt", across=True)):
        assert sorted((r.line_no, r.value.encode()) for r in df.collect()) == want
    for path in (str(tmp_path), f"{tmp_path}/*.txt"):
        assert tuple(jsonl.manifest(spark, [path], across=True).first()[1:]) == (len(whole), hashlib.sha256(whole).hexdigest(), len(want))


def test_ranges_are_bounded_in_number():
    import json

    size = 1 << 32
    made = ranges.RangeReader({"mode": "lines", "split": "65536", "paths": json.dumps([("a", size)])}).partitions()
    assert len(made) <= ranges.MOST + 1 and made[-1].end == size  # were 65536, each task being sent a number for each


@pytest.mark.parametrize("name", ["s01_line_numbers", "s01_numbers_of_ranges", "s09_digests_of_documents"])
def test_written_folders_have_files_of_many_tasks(spark, tmp_path, monkeypatch, name):
    from lexmill import queries, queries_files

    monkeypatch.setattr(queries_files, "folder", lambda _: str(tmp_path / "out"))
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(8)
    d.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task a file
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        assert queries.QUERIES[name](spark, str(tmp_path / "in")).count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(list((tmp_path / "out").rglob("part-*"))) > 4
