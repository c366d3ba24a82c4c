import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _k1 string, node string, h int, size string, row string"


def words(seed, n, kind="w"):
    r = random.Random(seed)
    return [f"{kind}{r.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """Odd documents: nulls everywhere, empty and long texts, copies, repeats, columns with our names."""
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    texts = [
        (0, " ".join(base), "en", "a"),
        (1, " ".join(base), "en", "a"),
        (2, " ".join(near), "en", "b"),
        (3, " ".join(words(2, 90)), "en", "b"),
        (4, None, "fr", "b"),
        (5, "", None, None),
        (6, " \t\n\x0b\f\r ", "de", "c"),
        (7, "one two", "de", "c"),
        (8, "One  two", "de", "a"),
        (9, "\n".join(["the same line again and again and again"] * 4 + ["", "short", "short"]), "en", "a"),
        (10, " ".join(["x y z"] * 30) + " #*$%&|<>", "en", "a"),
        (11, " ".join(words(3, 40_000)), "en", "a"),
        (12, "Élan ÉCOLE naïve ß 日本語 — 123 456 a'b", "fr", "d"),
        (None, " ".join(words(4, 50)), "en", None),
        (None, None, None, None),
        (3, " ".join(words(2, 90)), "en", "b"),
        (14, "!!! ??? ...", "es", "d"),
        (15, "q" * 50_000, "es", "d"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), "k", "n", 1, "s", "r") for i, t, lang, s in texts]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
