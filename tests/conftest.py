import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from repolith.session import local_session

    folder = tmp_path_factory.mktemp("spark")
    session = local_session(4, memory="4g", name="tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(folder), "spark.sql.warehouse.dir": str(folder / "warehouse")})
    yield session
    session.stop()
