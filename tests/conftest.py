import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path(os.environ.get("LEDGERLOOM_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import session

    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    out = session(
        "tests", "local[2]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": folder, "spark.driver.memory": "3g", "spark.sql.warehouse.dir": f"{folder}/warehouse"}
    )
    out.sparkContext.setLogLevel("OFF")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.exists():
        pytest.skip("no test tables")
    return str(DATA)
