"""Small documents with copies, near copies, repeated lines, leaks, nulls, empty texts and ties."""

from __future__ import annotations

import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("sto", "ven", "lim", "dar", "fos") for c in ("", "n", "ta", "rel", "is")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    rng = random.Random(11)
    base = [prose(rng, rng.randint(30, 150)) for _ in range(40)]
    near = [t.replace(t.split()[5], "zzz", 1) for t in base[:10]]
    lines = "\n".join([prose(rng, 12), "this line is found in many documents of the set", prose(rng, 9)])
    passage = prose(rng, 60)
    return [*base, *near, *base[:5], lines, lines.replace("many", "some"), f"{prose(rng, 20)} {passage} {prose(rng, 20)}", f"{passage} {prose(rng, 9)}", None, "", " \n\n ", "!!! ???", "one", "Ünïcödé 漢字 text ▁ mark", "x" * 5000, prose(rng, 8000)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids with a null and a repeat; a column whose name clashes with the operators' own."""
    rows = [(None if i == 3 else i, t, ("en", "fr", None)[i % 3], f"s{i % 2}", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, node int").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, node int")
