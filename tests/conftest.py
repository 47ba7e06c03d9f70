import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from twinfold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session("8", **{"spark.checkpoint.dir": folder, "spark.sql.shuffle.partitions": "3"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
