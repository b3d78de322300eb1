import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, h string, more string, fp long, ids string"


def rows_of(texts):
    """Documents with columns whose names the operators use themselves."""
    return [(i, t, l, "s", None if t is None else len(t), "k", "t", "h", "m", 7, "x") for i, t, l in texts]


def words(seed, n, lang="en"):
    rng = random.Random(seed)
    parts = {"en": ["the", "and", "tion", "ing", "er", "of", "th", "ou"], "de": ["und", "der", "sch", "ich", "ung", "ei", "zu", "ä"], "fr": ["les", "que", "eau", "é", "oi", "ment", "ou", "le"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def make_docs():
    rng = random.Random(5)
    passage, line = words(1, 60), words(2, 25)
    texts = [(i, words(100 + i, rng.randint(3, 150), rng.choice(["en", "de", "fr"])), rng.choice(["en", "de", "fr"])) for i in range(40)]
    texts += [(100 + i, words(500, 80), "en") for i in range(6)]  # exact copies
    near = words(600, 200).split(" ")
    for i in range(5):  # near copies
        w = list(near)
        w[10 + i] = "changed"
        texts.append((120 + i, " ".join(w), "en"))
    texts += [(140 + i, f"{words(700 + i, 10)} {passage} {words(800 + i, 10)}", "en") for i in range(4)]
    texts += [(150, f"{line}\n\t {line}  {line}", "en"), (151, line, "de")]
    texts += [(160, None, "en"), (161, "", "fr"), (162, " \n\t ", None), (163, "12 34 --- !!", "de"), (164, "a", "en"), (None, "null id text of the and", "en"), (165, "x" * 5000, "en"), (166, words(9, 6000), "en"), (167, "é" * 40 + " ß ÄÖ 日本語 😀", "fr")]
    texts += [(168, words(500, 80), None), (164, "a", "en")]  # a repeated row
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
