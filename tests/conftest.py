import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from skiff.session import get_session

    s = get_session(
        app="skiff-tests",
        master="local[4]",
        shuffle_partitions=4,
        extra={"spark.sql.adaptive.coalescePartitions.enabled": "true"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="skiff-test-")
