import pytest

from chronolake.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
