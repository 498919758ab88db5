import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a DataFrame over a few partitions."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make
