import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, rep long, n long, salt int, body string"
WORDS = "alpha beta gamma delta omega sigma river stone cloud paper green quick brown silent".split()


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows; the columns after n_chars clash with inner names."""
    base = words(60, 1)
    texts = [
        None, "", "   \t\n", "one two", base, base, base.replace(" ", "  \n"), base.upper(), base + " tail", words(60, 2), "x" * 5000, words(60_000, 3), "<|endoftext|> a@b.c", "日本語 ééé ß", base,
    ]
    rows = [(k, t, ["en", None, "de"][k % 3], "s", len(t) if t else 0) for k, t in enumerate(texts)]
    rows += [rows[4], (None, base, None, None, None)]
    return [(*r, "k", 1, 2, 3, "b") for r in rows]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
