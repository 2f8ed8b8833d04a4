import os

import pytest

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Planted documents: copies, near copies, nulls, empty and long texts, ties, repeated rows, extra columns."""
    import random

    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, texts = prose(300), []
    near = base.split()
    for k in range(12):
        own = list(near)
        own[r.randrange(300)] = f"edit{k}"
        texts.append(" ".join(own))
    texts += [base, base.upper(), base, None, "", "  \n", "one two", "One  TWO", "one two three four five", "ünï çödé 日本 ▁ x", "x" * 3000, prose(9000), "</s>[INST]", "12 34 !!"]
    texts += [prose(r.randint(1, 120)) for _ in range(60)]
    rows = [(i, t, ["en", "fr", "de", None][i % 4], ["hot", "hot", "cold", None, ""][i % 5], len(t or ""), 1, "x") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id here at all", None, None, 3, 1, "x"), (None, None, None, None, 0, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int, score string")


@pytest.fixture
def tables():
    if not os.path.isdir(TABLES):
        pytest.skip("needs the test tables")
    return TABLES
