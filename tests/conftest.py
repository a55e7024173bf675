import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gapweave.session import build_session

    # Stage tables of the session live and go with it.
    with tempfile.TemporaryDirectory(prefix="spark-", dir="/tmp", ignore_cleanup_errors=True) as folder:
        session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.checkpoint.dir": folder})
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()
