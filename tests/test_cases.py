"""Rules over given rows against results worked out by hand."""

import collections

import pytest

from quercus.queries_more import CASES
from test_oracle import plain


@pytest.mark.parametrize("name", list(CASES))
def test_case(spark, name):
    f, columns, expected = CASES[name]
    df = f(spark)
    assert sorted(df.columns) == sorted(columns)
    got = collections.Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    assert got == collections.Counter(tuple(plain(v) for v in r) for r in expected)
