import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from leakgauge import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.driver.host": "127.0.0.1",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def tiny_model(spark):
    """A small forest that flags long names."""
    from leakgauge.contract import MODEL_FEATURES
    from leakgauge.plans.forest import ForestSpec, fit_forest

    rows = [
        (i % 2, *(float(v) for v in ((55 + i % 7 if i % 2 else 10 + i % 7), (40 if i % 2 else 5), 3, 3.0, 0.1, 0.1, 40 if i % 2 else 3, 1, 1, -1)))
        for i in range(80)
    ]
    df = spark.createDataFrame(rows, "label int, " + ", ".join(f"{f} double" for f in MODEL_FEATURES))
    return fit_forest(df, ForestSpec(depth=3, trees=5))
