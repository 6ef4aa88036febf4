"""Every registered query against its SQL on the smallest given tables."""

import os

import pytest

import __spark_entry__ as contract
import verify
from workload import registry

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not there")


@pytest.fixture(scope="module")
def duck():
    return verify.connect(SF_DIR)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_same_as_sql(spark, duck, name):
    state, n, _, note = verify.compare(spark, duck, name, SF_DIR)
    assert state == "ok", note


def test_entry_has_rows(spark):
    assert contract.entry(spark).columns == ["items", "length", "support", "freq"]
