import pytest

#: Extra columns whose names operators use inside.
EXTRA = "row string, key long, ids string, score double, print long, kept boolean, h1 long, n long, line string, words string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def rows_of(texts, langs=("en", "de", None), sources=("s0", "s1", None)):
    """(doc_id, text, …) of (doc_id, text) pairs, extra columns filled with nulls."""
    return [(d, t, langs[i % len(langs)], sources[i % len(sources)], None if t is None else len(t), *[None] * 10) for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    def build(texts):
        return spark.createDataFrame(rows_of(texts), SCHEMA)

    return build


PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the deep blue cellar of an old castle near the river"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
#: Nulls, empty and very long texts, repeated rows, one id with two texts, no id.
ODD = [
    (1, PROSE),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, PROSE),
    (5, PROSE),
    (6, " \t\n\x0b"),
    (7, PROSE + " and back"),
    (7, "something else entirely, on two\nlines of text that are long enough"),
    (None, PROSE),
    (None, None),
    (8, "lines of text that are long enough\nÄÖÜ 日本語 \U0001f600 text with letters of all kinds\n"),
    (9, LONG + " tail"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
