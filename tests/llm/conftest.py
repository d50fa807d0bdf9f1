import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Small documents with nulls, empty and long texts, copies and near copies: (doc_id, text)."""
    rng = random.Random(1)
    words = [f"word{i}" for i in range(300)] + ["the", "of", "Über", "ñandú", "x,y", "3.5"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, make(rng.choice((3, 20, 80, 150)))) for i in range(60)]
    passage = make(70)
    for i in range(60, 90):
        base = rows[i % 7][1].split()
        base[rng.randrange(len(base))] = "changed"
        rows.append((i, " ".join(base)))
    rows += [(90 + i, make(20) + "\n" + passage + "\n" + make(30)) for i in range(6)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, " \n\t "), (105, make(6000)),
             (106, "same " * 400), (107, "same " * 300), (102, None), (100, rows[3][1]), (None, rows[3][1]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With extra columns whose names the operators use inside."""
    rows = [(i, t, "k", 1, 2.0) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string, n int, score double").repartition(3)
