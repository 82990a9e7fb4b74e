import os
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(HOME))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(HOME), os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from hearthlog import session

    s = session.build("local[8]", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
