import pytest

from codeweft.core import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def rows():
    def collect(df, *cols):
        return sorted((tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]) for r in df.select(*cols).collect())

    return collect
