"""Small document tables for the tests of this folder."""

import numpy as np

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def words(seed: int, n: int) -> list[str]:
    draw = np.random.default_rng(seed)
    return ["".join(draw.choice(list("abcdefghijklmnopqrst"), draw.integers(2, 9))) for _ in range(n)]


def text(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


def docs(spark, rows):
    """Documents from (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def collected(df):
    return [tuple(r) for r in df.collect()]
