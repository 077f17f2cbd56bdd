import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from codeweft.session import local_session

    shared = f"file://{tmp_path_factory.mktemp('shared')}"
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=shared, spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="session")
def same():
    """Compares a frame with a DuckDB result as multisets of rows."""

    def check(frame, con, sql):
        rows, names = frame.collect(), frame.columns
        result = con.execute(sql)
        theirs = [d[0] for d in result.description]
        assert sorted(names) == sorted(theirs)
        order = [theirs.index(c) for c in sorted(names)]
        mine = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows)
        assert mine == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())

    return check
