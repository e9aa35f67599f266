import pytest

from check import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = session("4", str(tmp_path_factory.mktemp("shared")))
    found.sparkContext.setLogLevel("ERROR")
    return found
