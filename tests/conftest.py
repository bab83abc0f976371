import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemill.session import build_session, scratch_database  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def new_table(spark):
    """Names of tables nobody has used yet."""
    import uuid

    database = scratch_database(spark)
    return lambda name: f"{database}.{name}_{uuid.uuid4().hex[:12]}"
