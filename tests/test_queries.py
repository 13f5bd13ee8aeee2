"""Each query of the library gives the rows of its DuckDB SQL."""

import os
import subprocess
import sys

import pytest
from oracle import SF_DIR, differences

import __spark_entry__ as entry
from lectern.plans import queries


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_matches_its_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF_DIR), queries.ORACLE_SQL[name], SF_DIR) == []


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_entry_can_be_imported_before_there_is_a_session():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=root, check=True)
