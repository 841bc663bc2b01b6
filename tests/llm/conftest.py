import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty, blank, tiny and very long texts, repeated rows, copies, clashing extra columns."""
    long = prose(1, 60_000)
    texts = [(0, None), (1, ""), (2, " \t\n"), (3, "word"), (3, "word"), (4, long), (5, long + " end"), (6, prose(2, 200)), (7, prose(2, 200)), (8, prose(3, 90) + " bob@example.com"), (9, "Ünïcödé 漢字 😀 <|endoftext|>"), (None, "no id here at all"), (10, prose(2, 199) + " x")]
    rows = [(i, t, None if k % 3 else "en", None, None if t is None else len(t), "x", k, 1.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, terms string, rep int, key double")


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)
