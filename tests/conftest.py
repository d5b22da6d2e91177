import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kinsift.session import get_spark

    session = get_spark("kinsift-tests", cores="4", partitions="4", extra={"spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()
