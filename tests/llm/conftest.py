import random

import pytest

EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, key string, bucket int, part int, component bigint, takes int, chunk int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts and sources, an empty and a very long text, repeated rows, one id twice, and columns whose names the
    operators use inside."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(30_000))
    texts = [(None, "some words without an id"), (1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "a first text"), (4, "another text"), (5, long), (6, "   \n \t"), (7, "é ß İ 中文 🙂 <|endoftext|>")]
    rows = [(i, t, None if i == 4 else "en", None if k % 3 == 0 else "s", None if t is None else len(t), 1, "k", 2, 3, 4, 5, 6) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def corpus(spark):
    """(doc_id, text, lang, source, n_chars) of 120 documents with exact and near copies and a shared passage."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 200))) for _ in range(80)]
    for k in range(20):
        ws = texts[k].split()
        ws[rng.randrange(len(ws))] = "changed"
        texts.append(" ".join(ws))
    texts += texts[:10]
    texts += [" ".join(rng.choices(vocabulary, k=20)) + " " + passage + " " + " ".join(rng.choices(vocabulary, k=20)) for _ in range(10)]
    rows = [(k, t, "en", f"s{k % 4}" if k % 3 else "hot", len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
