import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, comp long, key string, shard int, score double, kept boolean, topic string, part long, n long"
EXTRA = ("clash", 1, 2, "k", 3, 0.5, False, "t", 4, 5)


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()) + str(r.randrange(50)) for _ in range(n))


def rows() -> list[tuple]:
    base = words(1, 120)
    near = base.replace("1", "1", 1).split()
    near[60] = "changed"
    long = words(2, 40_000)
    out = [
        (1, "Hello World, this is a small text.", "en", "a"), (2, "hello world, THIS is a small text.", "en", "b"), (3, "", "en", "a"), (4, None, None, None), (5, "   \n\t ", "de", ""),
        (6, base, "en", "a"), (7, " ".join(near), "en", "a"), (8, base.upper(), "fr", "c"), (9, long, "en", "a"), (10, long + " tail", "en", "a"), (11, "two words", "en", "b"),
        (12, "TWO  words", "en", "b"), (13, "éÀ ünï  ÇÖDE ß", "de", "b"), (14, "12345 !!! ???", "en", "a"), (15, "line\none\n\ntwo  spaces <|endoftext|> x", "en", "c"), (None, "no id", "en", "a"),
        (20, words(3, 300), "en", "a"), (20, words(3, 300), "en", "a"), (21, words(4, 5), "es", "d"), (22, words(5, 2500), "de", "d"), (23, "a b c d e", None, "d"), (-5, "negative id", "en", "a"),
    ]
    return [(i, t, lang, s, len(t or "")) + EXTRA for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/work"
