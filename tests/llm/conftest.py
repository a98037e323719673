"""Documents with every awkward case, and a table of them with columns whose names clash."""

import random

import pytest

PLACES = "river hill market harbour meadow castle bridge garden tower valley forest island station church mill".split()
WORDS = [f"{a}{b}" for a in ("stone", "wind", "rain", "snow", "light", "dark", "old", "new") for b in PLACES]
PASSAGE = " ".join(WORDS[3:23])
ITEM = "The quick brown ox jumps over a lazy dog and then it sleeps in warm sun"


def make_texts() -> list[tuple[int | None, str | None, str | None]]:
    rnd = random.Random(5)
    sentence = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    base = sentence(120)
    rows: list[tuple[int | None, str | None, str | None]] = [(0, base, "en"), (1, base, "en"), (2, None, "en"), (3, "", None), (4, " \t\n", "en"), (5, "One two", "en"), (6, "one  TWO", "en")]
    for i in range(7, 15):  # edited copies
        w = base.split()
        for _ in range(i - 6):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        rows.append((i, " ".join(w), "en"))
    rows += [(15, f"{sentence(30)} {PASSAGE} {sentence(30)}", "en"), (16, f"{PASSAGE}\n{sentence(9)}", "en"), (17, f"{sentence(5)} {ITEM.upper()}! {sentence(5)}", "en")]
    rows += [(18, "quick brown ox jumps over a lazy dog and then", "en"), (19, "a" * 300 + " " + "b" * 450, "en"), (20, "Ünïcödé “quotes” — 中文 😀 œuvre " * 5, "de"), (21, "... !!! 123 456", "en")]
    rows += [(22, " ".join(sentence(50) for _ in range(60)), "en"), (23, "der die das und nicht " * 12, "de"), (24, "die und der nicht das Haus " * 9, "de"), (25, "the and of not house this " * 12, "en"), (26, "don't  stop\n\n  now \r\n ok ", "en")]
    rows += [(5, "One two", "en"), (27, "ababababab" * 40, "fr")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """(doc_id, text, lang) and columns that operators use names of."""
    extra = [(i, t, lang, 1, "x", [1.0], i, "k") for i, t, lang in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, n int, label string, first array<double>, rep long, key string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
