import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, bands string, digest string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with extra columns whose names the operators use inside."""

    def make(texts, first=1, lang="en", source="s"):
        rows = [(k, t, lang, source, None if t is None else len(t), "x", "y", "z") for k, t in enumerate(texts, first)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge(make_docs):
    """Null, empty, blank, ordinary, repeated, odd and very long texts, and rows without id, lang or source."""
    r = random.Random(1)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60_000))
    rows = make_docs([None, "", " \n\t ", "plain words only here", "plain words only here", "é ß \U0001f600 x", long, "12 @ +"])
    extra = rows.where("doc_id = 4").selectExpr("cast(null as long) doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "n_chars", "spans", "bands", "digest")
    return rows.unionByName(extra).unionByName(rows.where("doc_id = 4"))


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(n)]
