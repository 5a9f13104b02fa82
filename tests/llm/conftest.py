import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice(["ba", "ro", "ti", "mu", "ke", "sa", "lin", "dor"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]


@pytest.fixture
def make(spark):
    def docs(rows, schema=SCHEMA):
        return spark.createDataFrame([(*r, *([None] * (5 - len(r)))) for r in rows] if schema == SCHEMA else rows, schema)

    return docs


@pytest.fixture(scope="session")
def prose(words):
    def text(rng, n):
        out = []
        for i in range(n):
            w = rng.choice(words)
            out.append(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w)
        return "\n".join(" ".join(out[i : i + 36]) for i in range(0, n, 36))

    return text
