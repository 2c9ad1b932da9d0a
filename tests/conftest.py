import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import get_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="millrace-wh-", dir="/tmp")
    s = get_session("local[*]", shuffle_partitions=8, extra={"spark.sql.warehouse.dir": warehouse})
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
