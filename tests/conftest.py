import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from topicpulse.session import get_session
    s = get_session("local[4]", app="topicpulse-tests", shuffle_partitions=4,
                    extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                           "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="topicpulse-test-")


SF_SMALL = "/root/testdata/sf0.001"
