import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faultsift.session import build_session  # noqa: E402

NOW = dt.datetime(2026, 8, 10, 12, 30)
HOUR = dt.datetime(2026, 8, 10, 12)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def hours_ago(n: int) -> dt.datetime:
    return HOUR - dt.timedelta(hours=n)
