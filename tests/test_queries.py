"""Every registered query against its SQL, on the smallest driver tables."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect
from workload import corpus, events, relevance, wind

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not mounted")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


OWN = [name for group in (corpus, events, relevance, wind) for name in group.QUERIES]


def test_every_query_has_sql():
    assert set(OWN) <= set(oracle_sql()) and set(OWN) <= set(queries())


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, queries()[name], oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_entry_without_optional_parts():
    """Without the training-data operators everything else is still registered."""
    code = (
        "import sys; sys.modules['galeledger.llm'] = None; sys.modules['corpus_pipeline'] = None;"
        "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(OWN))] * 2
