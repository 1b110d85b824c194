import random

import pytest

from samples import SCHEMA, sentence


@pytest.fixture(scope="session")
def odd_rows():
    """Copies, near copies, nulls, empty, short and long texts, repeated rows, a hot source."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    rows = [(i, sentence(rng, rng.randint(1, 90)), "en", "a" if i % 3 else "b", 1) for i in range(30)]
    rows += [(40 + i, base, "de", "a", 1) for i in range(6)]
    for i in range(12):
        words = base.split()
        words[rng.randrange(120)] = f"edit{i}"
        rows.append((60 + i, " ".join(words), "de", "a", 1))
    rows += [(80, None, None, None, None), (81, "", "fr", "", 0), (82, " \t\n", None, "c", 3), (83, "one", "en", "c", 3),
             (84, sentence(rng, 5000), "en", "a", 1), (85, "One", "en", "c", 3), (83, "one", "en", "c", 3), (83, "one", "en", "c", 3),
             (86, "a b c", "en", "c", 1), (87, "A  B\tc", "en", "c", 1), (88, "Grüße 𝒳𝒴 an alle\x1cda\x85\xa0x", "de", "d", 1)]
    return rows


@pytest.fixture
def docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(docs):
    """The documents with extra columns named like those the operators add."""
    from pyspark.sql import functions as F

    names = ["size", "target", "source_size", "copies", "digest", "found", "key", "removed", "component", "kept", "class", "h1",
             "map_block", "mix", "part", "score"]
    return docs.withColumns({n: F.lit(n) for n in names})
