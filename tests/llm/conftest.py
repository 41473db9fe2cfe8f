import random

import pytest

WORDS = [a + b for a in ("an", "the", "ton", "re", "ing", "sh", "ble", "ou", "éta", "größ") for b in ("", "er", "ly", "is", "wh", "st")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empties, copies, near copies, a shared passage, very long texts, a repeated row."""
    rng = random.Random(3)
    base = sentence(rng, 120)
    near = base.replace(base.split()[60], "changed", 1)
    passage = sentence(rng, 40)
    out = [(0, None), (1, ""), (2, "  \n\t "), (3, "one two"), (4, "ONE two"), (5, base), (6, base), (7, near), (8, base + " more words at the end"), (None, base)]
    out += [(10 + i, sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 25)) for i in range(6)]
    out += [(20, "x" * 3000), (21, "ab " * 2000), (22, sentence(rng, 6000)), (23, "日本語 テキスト 😀 " * 10), (24, "Don't  stop\r\n\tit's 12 ½ <|endoftext|> İ"), (9, "z")]
    out += [(5, base), (9, None)]  # a repeated row, and one more row of a document
    return out


def unique(rows):
    """What counts of rows: one text for each id, the least that is not null."""
    best = {}
    for i, t in rows:
        if i not in best or best[i] is None or (t is not None and t.encode() < best[i].encode()):
            best[i] = t
    return best


@pytest.fixture(scope="session")
def docs(spark, rows):
    # columns with names that operators use inside
    schema = "doc_id long, text string, rep long, key string, n int, bucket int, source string, n_chars long, lang string, label int"
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, "s", len(t or ""), "en", 0) for i, t in rows], schema)


@pytest.fixture(scope="session")
def texts(rows):
    return unique(rows)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("doc_id < -1")
