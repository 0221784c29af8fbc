"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect
from wardenlake.plans import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_names_are_plain():
    assert not [n for n in QUERIES if n.startswith("op") and n[2:3].isdigit()]
    assert set(ORACLES) <= set(queries()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("module", ["public_tokenizers", "wardenlake.llm", "corpus_pipeline"])
def test_the_library_stands_alone(module):
    """Without the training-data part, or what it needs, the rest is registered all the same."""
    block = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; from wardenlake.plans import QUERIES; assert e.queries().keys() == QUERIES.keys()"
    done = subprocess.run([sys.executable, "-c", block], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    frame = queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in frame.collect()]
    assert len(set(frame.columns)) == len(frame.columns)
    if name in ORACLES:
        assert compare(rows, frame.columns, duck, ORACLES[name]) is None
