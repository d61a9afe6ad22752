"""Fixtures of the operators' tests."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, sig string, page string"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(("an", "er", "th", "on", "re", "sh", "Ti", "ou", "é", "ß")) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows(texts: list[tuple[int | None, str | None]]) -> list[tuple]:
    return [(i, t, "en", "src0", len(t or ""), "k", 1, "s", "p") for i, t in texts]


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, odd characters."""
    r = random.Random(5)
    base = words(r, 120)
    near = base.split()
    near[60] = "changed"
    long = "\n".join(words(r, 30) for _ in range(400))
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, long), (8, "a"), (9, "A b"), (10, "x\x00y ▁ <|endoftext|> </s> 😀 ① é"),
        (11, words(r, 40)), (11, words(r, 40)), (12, "same row"), (12, "same row"), (None, "no id"), (None, None), (13, words(r, 60) + ",. ;:"), (14, base.replace("an", "AN")),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    return spark.createDataFrame(rows(odd_texts), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
