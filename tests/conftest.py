import pytest

from tests.session import session


@pytest.fixture(scope="session")
def spark():
    return session()
