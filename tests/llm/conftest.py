from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score string, label int"


def make_rows():
    """Nulls in every column, empty and long texts, copies, near copies, shared passages, ties and repeated rows."""
    rnd = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tué", "rä") for b in ("no", "pe", "se", "ру") for c in ("", "ti", "x9", "!")]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    passage, near = prose(70), prose(120)
    texts = [None, "", " \t\n", "one", "two words", prose(9), passage, f"{prose(20)} {passage} {prose(15)}", f"{passage}\n{passage}", prose(3000), "a" * 20_000, "ab " * 4000]
    for _ in range(6):
        w = near.split()
        w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [near, near, "password: hunter2hunter2 and token=abc é AKIA" + "B" * 20, "x" * 49, "y" * 50, "y" * 50 + "z"]
    texts += [prose(rnd.randrange(1, 80)) for _ in range(30)]
    rows = [(i, t, "en" if i % 5 else None, f"src{i % 3}" if i % 4 else None, len(t or ""), "clash", None, i) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """With a null id, and rows that repeat."""
    return spark.createDataFrame([*rows[:9], *rows[5:9], (None, *rows[7][1:]), (None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
