import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from postwatch.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def col(spark):
    """Evaluate an expression over rows of values: col(ddl, rows, expr) -> list of results."""

    def run(ddl, rows, expr):
        df = spark.createDataFrame(rows, ddl).coalesce(1)
        return [r[0] for r in df.select(expr).collect()]

    return run
