import pytest

from postgeo.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
