import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodegraph.session import build

    folder = str(tmp_path_factory.mktemp("spark"))
    session = build("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir=f"{folder}/shared", spark__sql__warehouse__dir=f"{folder}/warehouse")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
