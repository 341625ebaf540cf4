import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import get_session
    s = get_session("local[4]", 4, app_name="ledgerlens-tests",
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ledgerlens-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="ledgerlens-test-")


SMALL = "/root/testdata/sf0.001"
