import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with results and inner columns of the operators.
CLASHING = ("kept", "component_id", "bucket", "node", "probability", "tokens", "line", "_dropped", "fingerprint", "h", "part", "_p")


def words(seed, n, size=400):
    pick = random.Random(seed)
    return [f"w{pick.randrange(size)}x" for _ in range(n)]


def hard_rows():
    """Nulls everywhere, empty and blank texts, one very long text, ties, repeated rows and copies."""
    base = " ".join(words(1, 120))
    near = base.split()
    near[60] = "changed"
    long = "\n".join(" ".join(words(s, 40, 5000)) for s in range(700))
    return [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), "en", "c"), (3, " ".join(near), "en", "c"),
        (4, None, "en", "a"), (5, "", "en", None), (6, " \n\t ", None, "a"), (7, "one", None, None), (8, "two words", "de", "b"),
        (9, long, "en", "a"), (10, "ZÄ é 😀 日本", "xx", "z"), (None, base, "en", "a"), (None, None, None, None), (11, "one", "en", "d"),
    ]


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows with clashing extra columns."""
    rows = [(*r, len(r[1] or "")) for r in hard_rows()]
    df = spark.createDataFrame(rows, DOCS)
    for name in CLASHING:
        df = df.selectExpr("*", f"'extra' AS `{name}`")
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def docs_of(spark):
    def make(texts, lang="en", sources=None):
        rows = [(i, t, lang, sources[i] if sources else f"s{i % 7}", len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make
