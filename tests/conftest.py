import pytest

from strandweave.runtime import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", cpus=8, partitions=4)
