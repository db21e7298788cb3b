import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from llm_data import HARD, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def hard(spark):
    """HARD with extra columns whose names the operators use themselves."""
    rows = [(*r, 1, 2, 3.0, "z", 4) for r in HARD]
    return spark.createDataFrame(rows, SCHEMA + ", id int, size int, score double, v string, copies int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (7, None, None), (6, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
