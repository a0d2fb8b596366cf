import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, size int, node string, host string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(3)
    passage, base = words(rng, 70), words(rng, 120)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", " \n ", "one", "Zwölf Boxkämpfer\x1cjagen <|endoftext|> 's 漢字 İstanbul ΣΑΣ é", passage, words(rng, 30) + " " + passage + " " + words(rng, 40), base, base, " ".join(near), "ab " * 200, words(rng, 9000), words(rng, 6) + "\n\n" + words(rng, 8) + "\nx", "a" * 900, "b" * 150 + "a" * 300]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if i % 6 == 0 else len(t or ""), "clash", None, "clash", None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[5], (None, "no id " + passage, None, None, None, None, None, None, None), (3, "another text with the same id", "de", "s1", 5, None, 1, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
