import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from sectloom.plans.runtime import session

    s = session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.autoBroadcastJoinThreshold": "1m"})
    yield s
    s.stop()
