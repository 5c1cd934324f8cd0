import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from newsloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "newsloom-tests", spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Values of a column expression over a list of strings, in order."""
    from pyspark.sql import functions as F

    def run(fn, values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        out = rows.select("i", fn(F.col("v")).alias("r")).collect()
        return [r["r"] for r in sorted(out, key=lambda r: r["i"])]

    return run
