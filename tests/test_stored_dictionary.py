"""JN-1 / AGG-6 / SNK-6: a bucketed dictionary is looked up without an exchange of its own, and
merging parts equals building from all of them."""

import random

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.operators import dictionary as D
from lexiflow.operators import stored_dictionary as SD


def corpus(spark, rows):
    return spark.createDataFrame(rows, "text string, standard string, pos long").repartition(3)


def rows_of(seed, n, start):
    rng = random.Random(seed)
    return [(rng.choice([f"Key {i}!" for i in range(60)] + [None, " "]), rng.choice([None, "x", "y", f"v{i}"]), start + i) for i in range(n)]


def content(df):
    return sorted((r.key, r.standard or "", r.pos) for r in df.select("key", "standard", "pos").collect())


def exchanges_above(plan, table):
    """Exchanges between the scan of a table and the join above it."""
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and table in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    found, level = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            level = depth(x)
            if "Join" in x:
                return found
            if "Exchange" in x:
                found.append(x)
    return found


def test_lookup_has_no_exchange_on_the_dictionary(spark, tmp_path):
    d = SD.StoredDictionary.create(spark, str(tmp_path / "d"), corpus(spark, rows_of(1, 300, 0)))
    q = spark.createDataFrame([(i, f"key {i % 80}") for i in range(200)] + [(900, None)], "id long, text string")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = d.lookup(q)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert d.table in plan and exchanges_above(plan, d.table) == [] and "Exchange hashpartitioning" in plan
        merged = d.rows().join(SD.entries(corpus(spark, rows_of(2, 9, 900))).withColumnsRenamed({c: f"n{c}" for c in ("_h1", "_h2", "key", "standard", "pos", "last")}), F.expr("_h1 = n_h1 and _h2 = n_h2 and key = nkey"), "full_outer")
        assert exchanges_above(merged._jdf.queryExecution().executedPlan().toString(), d.table) == []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    want = D.lookup(q, D.build_dictionary(corpus(spark, rows_of(1, 300, 0))), T.normalize_text)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.select(out.columns).collect()))


def test_merge_equals_rebuild_in_any_order(spark, tmp_path):
    parts = [rows_of(1, 120, 0), rows_of(2, 90, 120), rows_of(3, 40, 210)]
    whole = content(D.build_dictionary(corpus(spark, [r for p in parts for r in p])))
    for k, order in enumerate([(0, 1, 2), (2, 0, 1)]):
        path = str(tmp_path / f"m{k}")
        d = SD.StoredDictionary.create(spark, path, corpus(spark, parts[order[0]]))
        first = content(d.dictionary())
        later = d.merge(corpus(spark, parts[order[1]])).merge(corpus(spark, parts[order[2]]))
        assert later.version == 3 and content(later.dictionary()) == whole
        # the version that was opened first is still the same, and the latest is found
        assert content(SD.StoredDictionary.open(spark, path, 1).dictionary()) == first
        spark.sql(f"DROP TABLE {later.table}")  # as in another session
        again = SD.StoredDictionary.open(spark, path)
        assert again.version == 3 and content(again.dictionary()) == whole


def test_hot_keys_are_broadcast_and_versions_checked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SD, "HOT_LEAST", 20)
    d = SD.StoredDictionary.create(spark, str(tmp_path / "h"), corpus(spark, rows_of(1, 300, 0)))
    q = spark.createDataFrame([(i, "key 5" if i % 3 else f"key {i}") for i in range(300)] + [(i, None) for i in range(50)], "id long, text string")
    out = d.lookup(q, out_col="found")
    keyed = D._keyed(q, T.normalize_text, "text")
    assert len(d.hot_digests(keyed)) == 1 and out.count() == 350
    want = D.lookup(q, D.build_dictionary(corpus(spark, rows_of(1, 300, 0))), T.normalize_text, out_col="found")
    assert sorted(map(str, out.collect())) == sorted(map(str, want.select(out.columns).collect()))
    with pytest.raises(ValueError):
        SD.StoredDictionary.create(spark, str(tmp_path / "h"), corpus(spark, []))
    with pytest.raises(FileNotFoundError):
        SD.StoredDictionary.open(spark, str(tmp_path / "h"), 9)
    empty = SD.StoredDictionary.create(spark, str(tmp_path / "e"), corpus(spark, []))
    assert empty.lookup(q).where("lookup is not null").count() == 0
    assert content(empty.merge(corpus(spark, rows_of(1, 50, 0))).dictionary()) == content(D.build_dictionary(corpus(spark, rows_of(1, 50, 0))))
