import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session
    scratch = tempfile.mkdtemp(prefix="tessera-tests-")
    s = build_session("local[4]", app_name="tessera-tests", shuffle_partitions=8,
                      extra_conf={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    yield s
    s.stop()
