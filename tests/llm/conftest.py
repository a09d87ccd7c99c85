import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, key string, _size int, bucket int"


def words(n, seed, vocabulary=400):
    import random

    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, nulls, blanks, a very long text, repeated rows and a null id."""
    base = words(200, 1)
    near = base.split()
    near[100] = "changed"
    texts = [base, base, " ".join(near), None, "", "  \n\n ", "one", "two words", words(20_000, 2), base.upper(), words(90, 3) + "\n" + words(40, 4), words(40, 4) + "\n" + words(90, 5)]
    texts += [words(60, 100 + i) for i in range(20)]
    out = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], 1, 2, "k", 3, 4) for i, t in enumerate(texts)]
    return [*out, out[0], (None, "no id here " + words(30, 6), "en", "a", 1, 2, "k", 3, 4)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
