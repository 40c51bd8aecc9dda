import pytest

from kerbline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", **{"spark__sql__shuffle__partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
