import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siltstone.session import session

    shared = tmp_path_factory.mktemp("shared")
    settings = {"spark__master": "local[4]", "spark__sql__shuffle__partitions": "4", "spark__driver__memory": "4g", "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false", "spark__checkpoint__dir": f"file://{shared}"}
    found = session("tests", **settings)
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
