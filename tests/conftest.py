import glob
import os

import duckdb
import pytest

from siftwell.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 4, "6g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 7) + 0.0)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return sorted((plain(k), plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return repr(value)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    def check(query, sql):
        df = query(spark, SMALL)
        got = canonical([tuple(r) for r in df.collect()], df.columns)
        cursor = duck.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == canonical(cursor.fetchall(), columns)

    return check


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
