import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from veilstone.session import local_session

    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(int(os.environ.get("TEST_CPUS", "4")), 4, **{"spark.sql.warehouse.dir": str(warehouse), "driver_memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
