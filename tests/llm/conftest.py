import random

import pytest

WORDS = "the of and stone river quiet morning paper window green letter market seven harbour winter garden signal table bridge cloud number yellow silver evening forest travel simple winter candle mirror".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ly", str(rng.randint(0, 99))]) for _ in range(n)]
    return " ".join(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w for i, w in enumerate(words)) + "."


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, cls long, n long, __x string"


def documents(spark, texts, ids=None):
    """Documents with columns whose names operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 0.5, 7, 9, "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda texts, ids=None: documents(spark, texts, ids)
