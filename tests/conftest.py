import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cropline.schema import TABLES, schema_of  # noqa: E402
from cropline.session import build_session  # noqa: E402
from tests.fixtures import ROWS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    """The hand-made source tables of ``fixtures.py``."""
    return {name: spark.createDataFrame(ROWS.get(name, []), schema_of(name)) for name in TABLES}


@pytest.fixture
def rows_of():
    def collect(df, *columns):
        df = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
