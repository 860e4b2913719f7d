from __future__ import annotations

import random

import pytest

SYLLABLES = "ba ke lo mi nu ra se ti vo zu pe da".split()
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, label string, ids int, n_bytes int, found string, component string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def made_texts(seed: int = 5) -> list[str | None]:
    """Prose, near and exact copies, a shared passage, periodic and very long texts, empty and null ones."""
    rng = random.Random(seed)
    passage = sentence(rng, 120)
    texts: list[str | None] = [sentence(rng, rng.randint(20, 160)) for _ in range(24)]
    for base in texts[:6]:
        words = base.split()
        words[len(words) // 2] = "changed"
        texts += [" ".join(words), base, base.upper()]
    texts += [f"{sentence(rng, 60)} {passage} {sentence(rng, 40)}" for _ in range(5)]
    texts += [passage + "\n" + passage, "a" * 3000, "ab " * 900, "x " + "a" * 1200, sentence(rng, 9000)]
    texts += ["", None, " \n\t", "one", "two words", "one", "é" * 700, "日本 " * 300, "<|endoftext|> and 's 12 !!", "  two  spaces \n \n"]
    return texts


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with awkward texts, a repeated row, a null id, and columns that operators also make."""
    rows = [(i, text, ("en", "de", None)[i % 3], "s", None, 0.5, "x", 1, 2, "y", "z") for i, text in enumerate(made_texts())]
    rows += [rows[0], rows[24], (None, rows[1][1], None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1 if i % 4 else 0, 1 if i % 5 == 0 else 0) for i in range(40)] + [(3, None, None), (None, 1, 1), (0, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
