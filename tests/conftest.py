import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from findmill.session import build_session

    s = build_session(
        "tests", master="local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of one expression over one row of named string inputs."""

    def run(make, **inputs):
        names = list(inputs)
        row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{n} string" for n in names)) if names else spark.range(1)
        return row.select(make.alias("v") if hasattr(make, "alias") else make().alias("v")).first()["v"]

    return run
