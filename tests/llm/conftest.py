import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, n int, digit string, `group` string"
WORDS = "alpha beta gamma delta omega the of and to in is that was for on with as by at from or an be this which one you had not are but".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd():
    """Rows with nulls, empty, long and repeated texts, ties, copies, near copies and odd characters; extra columns clash with names used inside."""
    rng = random.Random(5)
    base, other = sentence(rng, 200), sentence(rng, 150)
    near = base.split()
    near[100] = "changed"
    passage = sentence(rng, 80)
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, other), (7, other), (8, other.replace(" ", "\n")), (None, base), (None, None),
        (9, "one two"), (10, "One  TWO"), (11, sentence(rng, 9000)), (12, sentence(rng, 60) + " " + passage + " " + sentence(rng, 40)), (13, sentence(rng, 10) + ". " + passage + "\n" + sentence(rng, 90)),
        (14, "a" * 900), (15, "Straße élan <|endoftext|> it's 12 345  x y　z 'll ́e \x00\x1c end"), (16, "ab" * 300), (17, base[:250]), (18, base.upper()), (19, "x"), (20, "\U0001f600 你好 " * 30),
    ]
    return [(i, x, "en", [None, "s1", "s0", "é", "z"][k % 5], len(x or ""), "k", "r", 1, "d", "g") for k, (i, x) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, odd):
    return spark.createDataFrame(odd, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
