import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, g string, label string, piece string"


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def rows(texts):
    """Documents with further columns, some of whose names the operators use inside."""
    return [(i, t, "en", "s", len(t or ""), "k", "g", "l", "p") for i, t in texts]


@pytest.fixture(scope="session")
def small(spark):
    """Made texts: copies, near copies, nulls, empty and blank texts, a long text, ties."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    texts = [make(r.randint(3, 120)) + r.choice(["", ".\n" + make(30)]) for _ in range(60)]
    for t in list(texts[:25]):
        w = t.split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "", None, " \n\t ", "one", "ONE ", make(20_000), "x " * 300, "a b c " * 100]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.createDataFrame(rows(small), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
