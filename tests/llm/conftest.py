import pytest

from cases import SCHEMA, SMALL, messy_rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark, messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def small(spark, messy):
    from storygauge.llm.common import documents

    return documents(spark, SMALL)


@pytest.fixture(scope="session")
def many_parts(spark):
    """Turns coalescing off, so that small tables keep their many partitions."""
    from contextlib import contextmanager

    @contextmanager
    def run():
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

    return run
