import random

import pytest

WORDS = "the river bends where old stones gather light and quiet boats drift past green fields under wide evening skies".split()


def prose(seed, n, breaks=9):
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) + str(rng.randrange(40)) for _ in range(n)]
    return " ".join(w + ("\n" if i % breaks == breaks - 1 else "") for i, w in enumerate(words)).replace("\n ", "\n")


#: Nulls, blanks, a very long text, copies, repeated rows, null and repeated ids.
MESSY = [
    (1, prose(1, 80)),
    (2, None),
    (3, ""),
    (4, " \n\t\n"),
    (5, prose(5, 40_000)),
    (6, prose(1, 80)),
    (7, prose(7, 60)),
    (7, prose(7, 60)),
    (None, prose(8, 70)),
    (None, None),
    (9, "Émile’s naïve café 東京 \U0001f600 " * 6),
    (9, prose(9, 3)),
    (10, "one"),
]


@pytest.fixture
def messy(spark):
    """The rows above, with columns whose names operators might use themselves."""
    rows = [(i, t, None if t is None else len(t), "x", 1.5, i, None) for i, t in MESSY]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, source string, n double, id bigint, hash string").repartition(3)


@pytest.fixture
def no_docs(messy):
    return messy.limit(0)
