import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    base = tmp_path_factory.mktemp("spark")
    s = session(4, "4g", **{"spark.sql.shuffle.partitions": "4", "spark.local.dir": str(base / "local"), "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": f"file://{base}/shared"})
    yield s
    s.stop()
