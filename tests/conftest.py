import pytest

from tests.session import spark_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = spark_session()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
