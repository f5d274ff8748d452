import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankloom.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def rng():
    return np.random.default_rng(5)


def unit_rows(rng, n, width=8):
    rows = rng.normal(size=(n, width))
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())
