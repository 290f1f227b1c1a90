from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barline.session import local_session  # noqa: E402

BASE = 1_727_740_800_000  # 2024-10-01T00:00:00Z
MINUTE = 60_000


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


def rows_of(df, *order):
    """Rows as tuples in the given order."""
    return [tuple(r) for r in df.orderBy(*order).collect()]
