"""SRC-1 / SRC-3: files cut at any byte give the records of the one-task reader."""

import os
import random

import pytest

from lexiflow.sources import csv as CSV
from lexiflow.sources import csv_split as SP
from tests.test_sources import STRICT


@pytest.fixture(params=["70b", "1m"])
def small_splits(spark, request):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(content)


def rows(df):
    keep = [c for c in df.columns if c not in ("pos",)]
    return [tuple(r[c] for c in keep) for r in df.orderBy("pos").collect()]


def rough(seed, n=40, end="\n"):
    """Records of all kinds: quoted newlines, doubled quotes, stray quotes, blanks around."""
    rng = random.Random(seed)
    pieces = ["a", "bé", "日本", "x y", "1", " ", '"q,\n\n z"', '"d ""e"" f"', '"tail"x', 'in"side', '"l1\nl2\nl3"', '""', "", '"long ' + "w " * 60 + 'end"', '"" "', '"a" ']
    lines = [",".join(rng.choice(pieces) for _ in range(rng.choice([1, 2, 3, 3, 3, 4]))) for _ in range(n)]
    lines[5:5] = ["", '"\n\n\n",b,c']
    return end.join(["text,label,standard", *[x.replace("\n", end) for x in lines]]) + end


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_equals_the_one_task_reader(spark, tmp_path, small_splits, seed, end):
    path = str(tmp_path / "in")
    write(f"{path}/a.csv", rough(seed, end=end))
    write(f"{path}/b.csv", rough(seed + 10, 25, end).rstrip("\r\n"))
    write(f"{path}/c.csv", STRICT.replace("\n", end))
    for kw in ({}, {"ignore_leading_ws": False}, {"columns": ["standard", "text"]}):
        one, bad_one = CSV.read_csv(spark, path, split=False, **kw)
        many, bad_many = CSV.read_csv(spark, path, split=True, **kw)
        assert rows(many) == rows(one)
        assert rows(bad_many) == rows(bad_one)
    for header in (True, False):
        one = CSV.read_ragged_csv(spark, path, header=header, split=False)
        assert rows(CSV.read_ragged_csv(spark, path, header=header, split=True)) == rows(one)
    if small_splits == "70b":
        assert SP.split_count(spark, path) > 20


def test_record_over_many_splits_and_position_order(spark, tmp_path, small_splits):
    path = str(tmp_path / "one.csv")
    body = "\n".join(f"{i}" for i in range(300))
    write(path, f'text,label\nbefore,1\n"{body}",2\nafter,3\n')
    got = rows(CSV.read_csv(spark, path, split=True)[0])
    assert got == [("before", "1"), (body, "2"), ("after", "3")]


def test_headers_modes_and_empty_files(spark, tmp_path):
    path = str(tmp_path / "h")
    write(f"{path}/a.csv", "x,y\n1,2\n3\n4,5,6\n")
    strict, _ = CSV.read_csv(spark, path, mode="strict", split=True)
    with pytest.raises(Exception):
        strict.collect()
    dropped, _ = CSV.read_csv(spark, path, mode="dropmalformed", split=True)
    assert rows(dropped) == rows(CSV.read_csv(spark, path, mode="dropmalformed", split=False)[0]) == [("1", "2")]
    write(f"{path}/b.csv", "y,x\n1,2\n")
    with pytest.raises(ValueError):
        CSV.read_csv(spark, path, split=True)
    write(str(tmp_path / "e/e.csv"), "x,y\n")
    assert rows(CSV.read_csv(spark, str(tmp_path / "e"), split=True)[0]) == []


def test_large_files_are_split_by_default(spark, tmp_path):
    path = str(tmp_path / "l.csv")
    write(path, rough(4, 200))
    assert not SP.is_large(spark, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert SP.is_large(spark, path)
        many, _ = CSV.read_csv(spark, path)
        assert many.select("text").rdd.getNumPartitions() > 3
        assert rows(many) == rows(CSV.read_csv(spark, path, split=False)[0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
