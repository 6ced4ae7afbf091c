"""The driver contract, and that queries and oracles go together."""

import __spark_entry__ as entry

from resolvent.plans import catalog


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.QUERIES) >= 150


def test_entry_gives_a_row_per_record(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 40 and any(r["n"] for r in rows)
