import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridweave.plans.common import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column expression over one row of named values."""
    from pyspark.sql import functions as F

    def run(build, *args, types=None):
        names = [f"a{i}" for i in range(len(args))]
        schema = ", ".join(f"{n} {t}" for n, t in zip(names, types or ["string"] * len(args)))
        return spark.createDataFrame([tuple(args)], schema).select(build(*[F.col(n) for n in names]).alias("x")).first()["x"]

    return run
