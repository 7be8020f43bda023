"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_and_registries(spark):
    assert entry.entry(spark).count() > 0
    made, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(made) and len(made) > 150
    assert all(callable(f) for f in made.values()) and all(isinstance(s, str) and s for s in sql.values())
