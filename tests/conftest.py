import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from orderpulse.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="orderpulse-test-")
    s = get_spark("local[4]", "orderpulse-tests",
                  {"spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": ckpt,
                   "spark.driver.memory": "6g"})
    yield s
    s.stop()
