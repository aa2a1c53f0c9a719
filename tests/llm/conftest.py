import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, rk string, doc string, found string, score string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=2 + i % 7)) for i in range(600)]


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Odd and copied texts: NULLs, blanks, repeats, near copies, shared passages, one very long text."""
    base, passage = prose(1, 200), prose(2, 60)
    words = base.split(" ")
    near = [" ".join(words[:k] + ["changed"] + words[k + 1:]) for k in (40, 90)]
    rows = [(0, base), (1, base), (2, near[0]), (3, near[1]), (4, base.upper()), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "One"),
            (10, "two words"), (11, prose(3, 90) + " " + passage), (12, passage + "\n" + prose(4, 70)), (13, prose(5, 30) + "  " + passage),
            (14, "la " * 120), (15, "la " * 90), (16, "é日本 \U0001F600 " * 20), (17, prose(6, 20_000)), (None, base), (None, prose(7, 80)),
            (18, prose(8, 60)), (18, prose(8, 60)), (18, prose(9, 60)), (19, "a b\x00c\x1fd"), (20, passage)]
    return rows + [(100 + i, prose(100 + i, 40 + i)) for i in range(30)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with columns whose names the operators might use themselves."""
    sources = [None, "b", "a", "c", ""]
    return spark.createDataFrame(
        [(d, t, "en", sources[i % 5], len(t or ""), "x", "x", "x", "x", "x") for i, (d, t) in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
