import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, fp long, pid int, language string"


@pytest.fixture(scope="session")
def corpus():
    """Rows of a small corpus in two made-up languages, with copies, toxic words, license lines, nulls, empty and long texts."""
    rng = random.Random(7)
    syl = {"en": ["th", "er", "on", "an", "re", "he", "in", "ed", "nd"], "fr": ["é", "le", "ou", "ai", "eau", "que", "ç", "ment"]}
    rows, labels = [], []
    for i in range(160):
        lang = "en" if i % 3 else "fr"
        words = ["".join(rng.choice(syl[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["stupid", "moron", "idiot"]))
        text = " ".join(words).capitalize() + "."
        if i % 11 == 0:
            text += "\nLicensed under the Apache License, Version 2.0."
        rows.append((i, text, lang, "src0"))
        labels.append((i, 1, int(toxic)))
    for i in range(20):  # exact and near copies
        rows.append((200 + i, rows[i % 3][1] + (" end" if i % 2 else ""), rows[i % 3][2], "src0"))
    rows += [(300, None, "en", None), (301, "", None, "s"), (302, "short", "en", "s"), (303, " \n\t ", "fr", "s"), (None, "a text without an id but with words enough to be kept", "en", "s"), (304, "1234 !!! \x1c ß Ǆ <|endoftext|> it's", "en", "s")]
    rows.append((305, "word " * 30000 + "the end of it", "en", "s"))
    rows.append(rows[5])  # a repeated row
    return [(a, b, c, d, len(b or ""), 0.5, 1, 2, 3, "x") for a, b, c, d in rows], labels


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus[0], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    return spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
