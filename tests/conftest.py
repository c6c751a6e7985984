import pytest

from tallyfold.session import drop_scratch, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", memory="6g")
    yield session
    drop_scratch(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a frame spread over several partitions, so that order never comes for free."""

    def make(data, schema, parts=5):
        return spark.createDataFrame(data, schema).repartition(parts)

    return make


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
