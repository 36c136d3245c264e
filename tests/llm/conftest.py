from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and tion ing erst ble hea thor oned wher anth resh lyin outh".split()
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)) + "."


def make_rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, license lines, benchmark passages, repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [None, "", " ", "one", "two words", base, base, near, base.upper() + "!", prose(rng, 3000), "Licensed under the Apache License, Version 2.0.\n" + prose(rng, 40), prose(rng, 30) + "\nReleased under the MIT License.", "GNU General Public License " * 3, "cc by", prose(rng, 50) + " " + PASSAGE + " " + prose(rng, 20), "A  B\n\nC\tD é 日本語 𝒳", "x" * 500]
    texts += [prose(rng, rng.randint(5, 200)) for _ in range(60)]
    sources = [None, "", "b", "a", "hot"]
    rows = [(i, t, "en" if i % 3 else None, sources[min(4, i % 9)], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[20]]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return make_rows()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(documents):
    """Columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    extra = ["size", "label", "node", "p", "band", "shard", "slot", "score", "row", "part", "sub", "digest", "own", "x", "rank", "weird.name"]
    return documents.withColumns({c: F.lit("extra") for c in extra})


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, "short item here"), (3, None), (None, PASSAGE), (4, ""), (1, PASSAGE)], "item_id long, text string")
