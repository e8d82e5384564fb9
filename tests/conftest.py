import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from attempt_grid import ATTEMPT_COLUMNS, ATTEMPT_SCHEMA, attempt_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = attempt_session(
        "attempt-grid-tests",
        {
            "spark.master": "local[4]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.maxMetadataStringLength": "4000",
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
            "spark.checkpoint.dir": str(folder / "shared"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def attempts(spark):
    """Builds a contract frame from attempt() rows."""

    def build(*rows):
        return spark.createDataFrame(
            [tuple(row[name] for name in ATTEMPT_COLUMNS) for row in rows], ATTEMPT_SCHEMA
        )

    return build
