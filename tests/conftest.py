import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    import tempfile

    warehouse = tempfile.mkdtemp(prefix="quarry-warehouse-")
    s = local_session(cores=4, shuffle_partitions=4, app="quarry-tests",
                      extra={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()
