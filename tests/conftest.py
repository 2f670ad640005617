from __future__ import annotations

import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stridelake.schemas import ACTIVITY  # noqa: E402
from stridelake.session import build_session  # noqa: E402

T0 = datetime(2024, 1, 1, 10, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def activity(spark):
    """Activity rows from (key, time, steps[, user]) in arrival order, all in one source partition."""

    def build(*rows, partition=0):
        data = []
        for seq, (key, time, steps, *user) in enumerate(rows):
            data.append((key, partition, seq, user[0] if user else key, "first", "last", steps, None, None, None, time))
        return spark.createDataFrame(data, ACTIVITY)

    return build


def at(days: float = 0, **more) -> datetime:
    return T0 + timedelta(days=days, **more)
