import glob
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from gneiss.session import build_session

    s = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def normal(v):
    """A value as text, floats rounded, whatever engine it is from."""
    import numpy as np

    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(normal, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: sorted(tuple(map(normal, r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="session")
def duck_rows(duck):
    def run(sql):
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        order = [names.index(n) for n in sorted(names)]
        return sorted(names), sorted(tuple(normal(r[i]) for i in order) for r in cur.fetchall())

    return run
