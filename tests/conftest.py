import pytest

from palimpsest.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return build_session("tests", "local[4]", 4, str(tmp_path_factory.mktemp("checkpoints")))
