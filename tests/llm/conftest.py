"""Small tables with everything awkward, and the tokenizers."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, part int, row string, score double"


@pytest.fixture(scope="session")
def words() -> list[str]:
    r = random.Random(5)
    return ["".join(r.choice(["an", "the", "or", "ti", "é", "ou", "st", "ñ"]) for _ in range(r.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def texts(words) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, ties, nulls, empty and very long texts, repeated rows, odd white space."""
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = prose(120), prose(40)
    rows: list[tuple[int | None, str | None]] = [(None, None), (1, None), (2, ""), (3, " \t\n "), (4, base), (5, base), (5, base), (None, base), (None, base)]
    rows += [(10 + k, " ".join(r.choice(words) if r.random() < p else w for w in base.split())) for k, p in enumerate([0.01] * 10 + [0.04] * 20 + [0.08] * 10)]
    rows += [(60 + k, f"{prose(60)} {passage}\n{prose(60)}") for k in range(70)]
    rows += [(200 + k, "aaaa " * (30 + k)) for k in range(6)] + [(210, "a" * 400), (211, "a" * 300 + "b" + "a" * 120)]
    rows += [(220 + k, prose(k)) for k in range(12)]
    rows += [(240, prose(30_000)), (241, f"{base.upper()}"), (242, "One two three  four \n\n five\x1csix\r\nseven 8,9 l'été <|endoftext|> 日本語 😀"), (243, "ÀÉ " * 40)]
    long = prose(3000)
    rows += [(250, long), (251, long[: len(long) // 2] + prose(10) + long[len(long) // 2 :]), (-7, prose(80) + " " + passage)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, texts):
    """With columns whose names the operators use themselves."""
    languages = ["en", "fr", None]
    rows = [(i, t, languages[k % 3], f"s{k % 2}", None if t is None else len(t), "x", k, "r", 0.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


class Union:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


@pytest.fixture
def union():
    return Union()
