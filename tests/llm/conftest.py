import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs or from {doc_id: text}; every other column is filled in."""
    def make(texts, source=lambda i: f"src{i % 3}", schema=DOCUMENTS):
        pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
        rows = [(i, t, "en", source(i) if i is not None else None, None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture
def prose():
    """Deterministic text of n words."""
    def make(n, seed=0):
        out, x = [], seed * 7919 + 17
        for _ in range(n):
            x = (x * 1103515245 + 12345) % (1 << 31)
            out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 50))
        return " ".join(out)

    return make


@pytest.fixture
def odd(docs, prose):
    """Nulls, empty and blank texts, repeated rows, ties, a very long text, characters of many bytes."""
    same = prose(80, 3)
    return docs([
        (None, None), (None, same), (0, None), (1, ""), (2, " \t\n "), (3, same), (3, same), (3, prose(60, 9)), (4, same), (5, same.upper()),
        (6, prose(40_000, 5)), (7, "ü" * 300 + " 漢字 " + "😀" * 40), (8, "x"), (9, "mit license token = abcdef123456"), (10, "0" * 100_000),
    ])
