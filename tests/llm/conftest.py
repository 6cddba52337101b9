import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest_llm import TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def texts():
    return dict(enumerate(TEXTS, 10))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "en", 1, "k", 2, 3) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, key string, length int, fp int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
