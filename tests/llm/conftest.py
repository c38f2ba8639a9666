import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """Nulls, empty and long texts, exact and near copies, shared passages and lines, unusual characters."""
    base = words(1, 300)
    near = base.copy()
    near[150] = "changed"
    passage = words(2, 80)
    lines = [" ".join(words(10 + i, 9)) for i in range(14)]
    texts = [
        " ".join(base),
        " ".join(near),
        " ".join(base),
        None,
        "",
        "",
        " ",
        "12 34 -- !!",
        "one two",
        " ".join(words(3, 90) + passage + words(4, 90)),
        " ".join(words(5, 60) + passage + words(6, 10)),
        "\n".join(lines),
        "\n".join([" ".join(words(40, 8)), *lines[:12], " ".join(words(41, 8))]),
        " ".join(words(7, 20_000)),
        "É́ é ﬁ ΑΣ <|endoftext|> It's 'twas 4½\n\n\t日本語 🎉🎉",
        "z" * 3000,
        "same line here\n" * 40,
    ]
    rows = [(i, t, "xx" if i % 3 else None, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def texts(corpus):
    return {r["doc_id"]: r["text"] for r in corpus.collect()}


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(corpus):
    """Extra columns with names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["key", "rep", "sha", "path", "bucket", "slot", "shard", "size", "score", "lang_pred", "spans", "h", "run", "at", "n", "ids", "_k", "_bucket", "lines_removed", "class_id", "virtual_slot", "sketch", "next_text"]
    return corpus.select("*", *(F.lit("x").alias(n) for n in names))
