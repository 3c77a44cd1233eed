"""SNK-2 / SET-3: a folder of line files gives one suffixed output per input, each line in place."""

import os

import pytest

from lexiflow.sources import lines as LN

FILES = {
    "a.txt": [f"line  {i}." for i in range(400)],
    "b c+d%.txt": ["x.y", "", "  z "],
    "noext": ["one", "two.", "three"],
    "empty.txt": [],
}


def clean(line):
    return " ".join(line.replace(".", "").split())


def test_folder_of_files(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for name, lines in FILES.items():
        (src / name).write_text("".join(x + "\n" for x in lines), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        report = {r.file: (r.n_lines, r.n_changed) for r in LN.cleanup_files(spark, str(src), out).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert report == {n: (len(ls), sum(clean(x) != x for x in ls)) for n, ls in FILES.items()}
    names = sorted(f for f in os.listdir(out) if not f.startswith("."))
    assert names == sorted(LN.suffixed(n) for n in FILES)
    for name, lines in FILES.items():
        folder = f"{out}/{LN.suffixed(name)}"
        parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
        text = "".join(open(f"{folder}/{f}", encoding="utf-8").read() for f in parts)
        assert text == "".join(clean(x) + "\n" for x in lines)
    back = LN.read_lines(spark, f"{out}/{LN.suffixed('a.txt')}", whole_folders=True)
    assert [r.before for r in back.orderBy("line_no").collect()] == [clean(x) for x in FILES["a.txt"]]
    with pytest.raises(FileExistsError):
        LN.cleanup_files(spark, str(src), out)


def test_equal_names_in_two_folders_are_refused(spark, tmp_path):
    for d in ("p", "q"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "same.txt").write_text("x\n")
    with pytest.raises(ValueError):
        LN.cleanup_files(spark, [str(tmp_path / "p"), str(tmp_path / "q")], str(tmp_path / "o"))
