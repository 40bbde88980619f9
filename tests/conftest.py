import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path(os.environ.get("LABELLOOM_TEST_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from labelloom.session import local_session

    return local_session(4, "labelloom-tests", 4)


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


def rows(df):
    """The rows of a small result, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
