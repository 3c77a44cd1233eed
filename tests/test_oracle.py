"""Every registered query with an oracle equals its DuckDB SQL on the sf0.001 tables."""

import os

import pytest

from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"
SLOW = {"variant_train_predict", "variant_train_report", "variant_train_balanced", "variant_predict"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_oracles(spark):
    import __spark_entry__ as E

    from lexiflow.plans.registry import REGISTRY

    E.queries()  # fills the registry; the optional subpackage has tests of its own
    names = [n for n in REGISTRY if n not in SLOW]
    res = compare(spark, SF, names, verbose=False)
    bad = {k: v for k, v in res.items() if v != "OK" and not v.startswith("rows-only")}
    assert not bad, bad
    assert "route_hybrid" in res and E.entry(spark).columns
