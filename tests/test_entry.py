"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as E


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 60


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["chrom", "start", "end", "parent1", "parent2", "n_sites"] and df.count() > 0
