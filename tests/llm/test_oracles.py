"""Queries with SQL equal it on the driver's small tables."""

import os

import pytest

from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_oracles(spark):
    res = compare(spark, SF, ["op8_stupid_backoff", "op9_one_bit_codes", "op12_quotient_collocations"], verbose=False)
    assert all(v == "OK" for v in res.values()), res
