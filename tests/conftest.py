import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    s = local_session(8, 8)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def rows():
    return lambda df, *columns: sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
