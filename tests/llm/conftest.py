import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, slot int, shard int"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice("aeioubcdfghlmnprst") for _ in range(rng.randint(2, 9))) for _ in range(400)]


@pytest.fixture
def make(spark):
    """Documents from texts, with extra columns whose names operators use inside; ids ascend from 0 unless given."""

    def build(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, None, "s", None if t is None else len(t), "k", 1, 2) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


