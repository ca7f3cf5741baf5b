"""Ranked search against brute force, with proofs at every tier and without any."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from voltaic.llm import search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def brute(docs, items, k=20):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    total = sum(sum(c.values()) for _, c in counted)
    n_docs = sum(1 for _, c in counted if c)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            if not c:
                continue
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(str(item), i + 1, str(d), -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out)


def result(df):
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """Rare and common words, long and short texts, copies, ties."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rnd.choices(words, weights, k=rnd.choice([0, 3, 20, 60, 300])))) for i in range(600)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)]
    items = [(i, " ".join(rnd.choices(words, weights, k=rnd.choice([1, 5, 30])))) for i in range(25)]
    items += [(100, "w399 w398 W397"), (101, ""), (102, None), (103, "nothing"), (104, docs[5][1]), (105, "w0")]
    return docs, items, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("tiers", [(4096, 65536), (40, 200), (5, 60), (0, 1)])
def test_every_depth_of_tiers(corpus, tiers):
    docs, items, d, b = corpus
    assert result(search.search(d, b, tiers=tiers)) == brute(docs, items)


def test_some_items_are_proven_early_and_others_fall_through(corpus, monkeypatch):
    docs, items, d, b = corpus
    at = []
    few, whole = search._few, search._all_tiers
    monkeypatch.setattr(search, "_few", lambda *a: at.append(("few", a[3].select("item").distinct().count())) or few(*a))
    monkeypatch.setattr(search, "_all_tiers", lambda *a: at.append(("all", a[2].n)) or whole(*a))
    assert result(search.search(d, b, k=5, tiers=(60, 250))) == brute(docs, items, 5)
    assert {kind for kind, _ in at} == {"few", "all"} and all(n for _, n in at)


def test_odd_tables(spark, docs, odd, empty, rows):
    given = [(r[0], r[1]) for r in rows]
    items = [(r[0], r[1]) for r in rows if r[0] % 2]
    wanted = docs.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "item_id")
    assert result(search.search(docs, wanted)) == brute(given, items)
    given = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(search.search(odd, odd, item_col="doc_id")) == brute(given, given)
    assert search.search(empty, wanted).count() == 0 and search.search(docs, empty, item_col="doc_id").count() == 0


def test_blocks_of_items(corpus, monkeypatch):
    docs, items, d, b = corpus
    monkeypatch.setattr(search, "ITEMS", 17)
    assert result(search.search(d, b)) == brute(docs, items)


def test_cuts_and_residuals():
    levels = np.zeros((3, search.LEVELS), np.int64)
    levels[0, [3, 10, 20]] = 5, 4, 3
    levels[1, 30] = 9
    cuts, left = search.tier_cuts(levels, (7, 100))
    assert cuts[0, 0] == 4 and left[0, 0] == (4 << search.LEVEL) - 1
    assert cuts[0, 1] == 31 and left[0, 1] == (31 << search.LEVEL) - 1
    assert (left[1] == 0).all() and left[0, 2] == 0
