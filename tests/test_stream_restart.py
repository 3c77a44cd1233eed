"""STR-1: a stream that fails is resumed from its checkpoint, no row twice, and a repeated batch
is routed with the dictionary version of its first attempt."""

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import stored_dictionary as SD
from lexiflow.streaming import router as SR


class Stop(Exception):
    pass


@pytest.mark.parametrize("when", ["while routing", "after writing"])
def test_restart_after_a_failed_batch_and_a_replaced_dictionary(spark, tmp_path, when):
    src, sink, ckpt, path = (str(tmp_path / x) for x in ("in", "out", "ckpt", "dict"))
    first = spark.createDataFrame([(f"key {i}", "old", i) for i in range(6)], "text string, standard string, pos long")
    d = SD.StoredDictionary.create(spark, path, first)

    def arrive(name, lo, hi):
        rows = [(f"r{i}", f"Key {i % 8}!", "x") for i in range(lo, hi)] + [("stop", " Q ", "x")]
        spark.createDataFrame(rows, "id string, text string, requested_label string").coalesce(1).write.mode("append").parquet(src)

    seen, fail_at = [], {"batch": 1}

    def route(batch, dictionary):
        seen.append(dictionary.version)
        if when == "while routing" and len(seen) - 1 == fail_at["batch"]:
            raise Stop("killed")
        out = dictionary.lookup(batch, out_col="translation")
        return out.select("id", "translation", F.lit(dictionary.version).alias("version"))

    def written(batch_id):
        if when == "after writing" and batch_id == fail_at["batch"]:
            raise Stop("killed")

    def start():
        return SR.start_router(spark, src, sink, ckpt, route, max_files_per_trigger=1, dictionary_path=path, after_batch=written)

    for k in range(3):
        arrive(k, 10 * k, 10 * k + 10)
    with pytest.raises(Exception):
        SR.run_to_completion(start())
    assert seen == [1, 1]
    new = spark.createDataFrame([(f"key {i}", "new", 100 + i) for i in range(4, 8)], "text string, standard string, pos long")
    assert d.merge(new).version == 2
    fail_at["batch"] = -1
    SR.run_to_completion(start())
    arrive(3, 30, 40)
    SR.run_to_completion(start())
    assert seen == [1, 1, 1, 2, 2]  # the killed batch again with its version, then the new one
    rows = spark.read.parquet(sink).collect()
    assert sorted(r.id for r in rows) == sorted(f"r{i}" for i in range(40))
    by_batch = {r.batch_id: r.version for r in rows}
    assert by_batch == {0: 1, 1: 1, 2: 2, 3: 2}
    for r in rows:
        key = int(r.id[1:]) % 8
        want = ("old" if key < 6 else None) if r.version == 1 else ("new" if key >= 4 else "old")
        assert r.translation == want
    SR.run_to_completion(start())  # nothing left to do
    assert len(seen) == 5
