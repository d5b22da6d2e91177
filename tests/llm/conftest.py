import pytest


@pytest.fixture(autouse=True, scope="session")
def few_partitions(spark):
    """Small tables: one setting for all of these tests."""
    spark.conf.set("spark.sql.shuffle.partitions", "3")
