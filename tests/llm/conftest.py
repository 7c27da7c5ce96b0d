import random

import pytest

WORDS = ("tree river stone cloud window garden paper winter summer bridge candle forest harbour island journey kitchen "
         "ladder market needle orange pocket quarter ribbon silver tunnel valley wagon yellow anchor basket").split()
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [None, "", " ", "a", "  two  blanks ", "line\n\nline\r\n", "日本語 text é ß\x01 \x85", "it's <|endoftext|> 'll 123", "🙂" * 5]


@pytest.fixture(scope="session")
def prose():
    """Deterministic sentences over a small vocabulary."""
    rng = random.Random(3)

    def make(n: int) -> str:
        out = []
        while n > 0:
            k = min(n, rng.randint(5, 12))
            out.append(" ".join(rng.choice(WORDS) for _ in range(k)).capitalize() + ".")
            n -= k
        return " ".join(out)

    return make


@pytest.fixture()
def documents(spark):
    """``documents`` of (doc_id, text) rows, with further columns whose names operators use themselves."""

    def make(rows):
        rows = [(i, t, "en", "src0", len(t or ""), "x", -1.0, 7, "y") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "fp string, score double, pos int, runs string")

    return make


@pytest.fixture()
def odd(documents):
    """Nulls, empty and very long texts, repeated rows, a null id."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, LONG), (51, LONG), (3, "a"), (None, "no id here")]
    return documents(rows)
