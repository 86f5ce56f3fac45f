import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from patronvoice.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of an expression over literal inputs."""

    def run(expr, **inputs):
        from pyspark.sql import functions as F

        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
        return df.select(expr.alias("x")).first()["x"]

    return run
