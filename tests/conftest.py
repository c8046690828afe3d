import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from plinth.session import build

    out = build("local[4]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(x):
    """A value as both engines can give it."""
    import datetime
    import decimal

    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal | float):
        return round(float(x), 9) + 0.0
    if isinstance(x, int):
        return round(float(x), 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def same_rows(df, duck, sql):
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(plain(v) for v in r) for r in df.select(columns).collect())))
    want = sorted(map(repr, (tuple(plain(v) for v in r) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())))
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    assert got == want, [p for p in zip(got, want, strict=True) if p[0] != p[1]][:3]
