import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE), str(HERE.parent)]
# Worker processes import the package and classes of test modules too.
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parent), str(HERE), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import build_session

    session = build_session("tests", "local[8]", **{"spark__sql__shuffle__partitions": "8", "spark__driver__memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
