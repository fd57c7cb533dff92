"""Every registered query against its SQL twin; QUICK=1 takes every third one.

The smallest scale is used where the twin has rows there, else the next one, where it must have some.
"""

import os

import pytest
from oracle_check import connect, differences

from factorframe.plans.catalogue import REGISTRY

FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")
NAMES = sorted(REGISTRY)
CHOSEN = NAMES[::3] if os.environ.get("QUICK") else NAMES


@pytest.fixture(scope="module")
def ducks():
    return {folder: connect(folder) for folder in FOLDERS}


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, ducks, name):
    q = REGISTRY[name]
    if q.sql is None:
        rows = q.run(spark, FOLDERS[1])
        assert rows.columns == list(q.columns) and rows.limit(1).count() == 1
        return
    for folder in FOLDERS:
        problems = differences(q.run(spark, folder), ducks[folder], q.oracle())
        if "oracle result is empty" not in problems:
            break
    assert not problems, "\n".join(problems)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["date", "ic", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
