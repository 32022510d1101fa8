import pytest

from shelfscope.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus=8)


@pytest.fixture
def folder(spark):
    from shelfscope.session import scratch_path

    return scratch_path(spark, "test")
