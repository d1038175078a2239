import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from fixtures import SCHEMA, texts  # noqa: E402

from quantloom.runtime import ship  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with every hard case, and extra columns whose names clash with internal ones."""
    ship(spark)
    rows = [(i * 3 + 1, t, ["en", None, "fr"][i % 3], ["a", "b", None][i % 3], len(t or ""), "clash", 7, "clash", 1, "clash", 0.5, 3, 2, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)
