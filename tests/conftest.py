import pytest

from slatewise.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", shuffle_partitions=4, memory="6g")
    yield session
    session.stop()
