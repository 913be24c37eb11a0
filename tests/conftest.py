import pytest

from tessera.session import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", "4", "4g", 4)
