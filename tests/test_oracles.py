"""Every registered query against its SQL at the smallest scale."""

import pytest

from check_oracles import compare
from venuelens.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    out = compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES.get(name))
    assert out.startswith(("ok", "rows only")), out
