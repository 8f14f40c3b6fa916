import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int, words: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows and ids, odd white space."""
    long = prose(1, 4000)
    texts = [
        (1, prose(2, 120)),
        (2, prose(2, 120)),
        (3, prose(2, 119) + " changed"),
        (4, None),
        (5, ""),
        (6, " \t\n"),
        (7, "one"),
        (8, "one two"),
        (9, long),
        (10, "intro " + long[:900] + " outro"),
        (11, "Ünïcode ﬁ x\x1cy 　z don't 12 3.5 <|endoftext|>\r\nEnd"),
        (12, "ÜNÏCODE"),
        (None, prose(3, 60)),
        (13, prose(4, 80)),
        (13, prose(4, 80)),
        (14, prose(5, 70)),
        (14, prose(6, 70)),
    ]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", len(t or "")) for i, t in texts], COLUMNS)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def crowded(docs):
    """The same rows with further columns of names that operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("fp", "seg", "key", "blob", "spans", "grp", "row", "hits", "host", "anchor", "content", "least", "node", "component", "u", "v", "shard", "p_toxic")})
