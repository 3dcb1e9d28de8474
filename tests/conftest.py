import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from demandcast.session import get_session  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="demandcast-tests", shuffle_partitions=4)
    yield s


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def panel_df(spark, rows, schema="date date, store int, item int, sales int"):
    """A small panel from (date, store, item, sales) tuples (ISO date strings allowed)."""
    fixed = [tuple(d(v) if isinstance(v, str) and len(v) == 10 and v[4] == "-" else v
                   for v in r) for r in rows]
    return spark.createDataFrame(fixed, schema)


def daily(start: str, n: int, values=None, store=1, item=1, step=1):
    """n rows of one series, one every ``step`` days from ``start``."""
    base = d(start)
    values = values if values is not None else list(range(1, n + 1))
    return [(base + dt.timedelta(days=i * step), store, item, values[i]) for i in range(n)]
