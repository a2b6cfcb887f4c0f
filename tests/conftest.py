import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from paylake.session import build_session, checkpoint_root
    s = build_session("local[4]", 8, app_name="paylake-tests",
                      extra={"spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    # tests only: a checkpoint folder when the session names none
    if not s.conf.get("spark.checkpoint.dir", None):
        checkpoint_root(s, tempfile.mkdtemp(prefix="paylake-test-ckpt-"))
    yield s
    s.stop()
