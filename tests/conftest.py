import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakeweave.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="lakeweave-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="lakeweave-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_dir():
    return SMALL
