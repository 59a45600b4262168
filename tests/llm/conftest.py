from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def sf(spark: SparkSession) -> str:
    return "/root/testdata/sf0.001"
