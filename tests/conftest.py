import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

TESTDATA = Path("/root/testdata")


def pytest_configure(config):
    # columns need a running session, also those built when a test file is read
    from pageloom.session import local_session

    config.spark = local_session(app="tests")


@pytest.fixture(scope="session")
def spark(pytestconfig):
    yield pytestconfig.spark
    pytestconfig.spark.stop()


@pytest.fixture(scope="session")
def small_dir():
    path = TESTDATA / "sf0.001"
    if not path.exists():
        pytest.skip("test tables are not here")
    return str(path)


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one expression over one row of named strings."""

    def run(expr, **columns):
        df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
        return df.select(expr.alias("out")).first()[0]

    return run
