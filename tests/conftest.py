import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sparkmail.session import get_spark

    s = get_spark(app="sparkmail-tests", master="local[4]", shuffle_partitions=8, driver_memory="4g")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkmail-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


SF = "/root/testdata/sf0.001"
