import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """Seeded invented prose."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["an", "the", "or", "in", "er", "st", "ou", "ti", "é", "ng"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def text(n, seed):
        r = random.Random(seed)
        out = []
        while n > 0:
            k = min(n, r.randint(4, 12))
            out.append(" ".join(r.choice(words) for _ in range(k)).capitalize() + ".")
            n -= k
        lines = [" ".join(out[i : i + 3]) for i in range(0, len(out), 3)]
        return "\n".join(lines)

    return text


@pytest.fixture(scope="session")
def odd_texts(prose):
    """Nulls, empty, blank, tiny, very long and repeated texts."""
    return [None, "", " \n\t ", "a", "word", "two words", prose(60, 1), prose(60, 1), prose(30_000, 2), "x" * 70_000, "é日 \x00　ab\r\n\n  c\td ▁e",
            "\n".join(["same line of some length here"] * 30)]
