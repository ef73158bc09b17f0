import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from terrascore.session import get_session

    s = get_session("local[4]", shuffle_partitions=8,
                    extra={"spark.driver.memory": "4g"})
    # tests set their own shared folder (a cluster names it in spark.checkpoint.dir)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrascore-test-"))
    yield s
    s.stop()
