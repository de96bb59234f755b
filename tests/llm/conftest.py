import pytest

#: Extra columns with names that operators might use themselves.
CLASHES = ["identified", "matches", "lines", "ids", "round_trip", "found", "text_hash", "digest", "copies", "row", "id", "value", "key", "n", "label"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)


def document(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), *["x"] * len(CLASHES))


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([document(*r) for r in rows], SCHEMA)

    return make


ENGLISH = "the quick brown fox jumps over the lazy dog and then it goes on with the long tale of the house by the river"
GERMAN = "der schnelle braune fuchs springt über den faulen hund und dann geht die lange geschichte vom haus am fluss weiter"


@pytest.fixture(scope="session")
def odd(frame):
    """Null, empty, blank and letterless texts, one very long, repeated rows, null ids and languages."""
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "12 34 !? ..."), (5, ENGLISH), (5, ENGLISH), (6, GERMAN, "de"), (7, ENGLISH, None), (None, ENGLISH), (None, None, None), (8, "x" * 60_000), (9, f"{ENGLISH}\n" * 900), (10, GERMAN, "de"), (11, ENGLISH)]
    return frame(rows)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
