import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session


def approx(rows, names, digits=9):
    return [tuple(None if r[n] is None else (round(r[n], digits) if isinstance(r[n], float) else r[n]) for n in names) for r in rows]
