import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from boutlens.session import session

    s = session("tests", "local[8]", 8, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()
