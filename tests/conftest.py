import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]


@pytest.fixture(scope="session")
def spark():
    from tillroll.session import checkpoint_dir, get_spark

    s = get_spark("local[4]", 4, app_name="tillroll-tests")
    checkpoint_dir(s)
    yield s
    s.stop()
