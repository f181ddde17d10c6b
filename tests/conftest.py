import pytest

from quarrymill.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "6g")
    yield s
    s.stop()
