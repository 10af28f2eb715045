"""Every business query against its SQL."""

import pytest
from conftest import rows_of

from bizframe.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        want = rows_of([d[0] for d in cur.description], cur.fetchall())
        assert rows_of(df.columns, got) == want
    else:
        assert got
