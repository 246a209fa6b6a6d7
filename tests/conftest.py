import pytest

from exposight.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", app="tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Evaluate columns over literal rows: ``one(rows, schema, col...) -> list of tuples``."""

    def run(rows, schema, *columns):
        return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]

    return run
