"""The attention queries against their SQL, whose three columns of the maintenance registry go by the names that its own CTE gives them."""

import duckdb
import pytest

from runlens import catalog
from tests.test_monitoring import SF, plain

NAMES = {"mreg WHERE active AND NOT maintained)": "mreg WHERE active_lakehouse_table AND NOT maintained_table)", "mreg WHERE lag_seconds >": "mreg WHERE maintenance_lag_seconds >"}


@pytest.mark.parametrize("name", ["o14_attention_inputs", "o15_attention_all", "o15_attention_queue"])
def test_attention_equals_sql_with_the_registrys_names(spark, name):
    con, sql = duckdb.connect(), catalog.oracle_sql()[name]
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for old, new in NAMES.items():
        sql = sql.replace(old, new)
    r = con.execute(sql)
    order = [x[0] for x in r.description]
    df = catalog.queries()[name](spark, SF)
    assert df.columns == order
    assert sorted((tuple(map(plain, x)) for x in df.collect()), key=str) == sorted((tuple(map(plain, x)) for x in r.fetchall()), key=str)
