import pytest


@pytest.fixture
def rows(spark):
    """A frame from tuples, split over a few partitions."""

    def make(data, schema):
        return spark.createDataFrame(data, schema).repartition(3)

    return make
