"""Suffix-array and suffix-tree deduplication against brute force."""

import hashlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.llm import _repeats, suffix_array, suffix_tree
from voltaic.llm.suffix_array import OP4_SQL
from voltaic.llm.suffix_tree import OP6_SQL


def brute_bytes(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        gone = gone[:-1]
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, "u1")[~gone].tobytes()).hexdigest())
    return out


def brute_words(rows):
    counts = Counter(tuple(w[i : i + 35]) for _, t in rows for w in [(t or "").encode().split()] for i in range(len(w) - 34))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if counts[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def bytes_of(df, hot=_repeats.HOT):
    return replace(suffix_array.FINDER, hot=hot).removed(df, "doc_id", "text", suffix_array._finish, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def words_of(df, hot=_repeats.HOT):
    return replace(suffix_tree.FINDER, hot=hot).removed(df, "doc_id", "text", suffix_tree._finish, "n_words bigint, n_removed bigint, kept_sha256 string")


def test_bytes(docs, rows):
    assert {r[0]: tuple(r)[1:] for r in bytes_of(docs).collect()} == brute_bytes([r[:2] for r in rows])


def test_words(docs, rows):
    assert sorted(map(tuple, words_of(docs).collect()), key=str) == brute_words([r[:2] for r in rows])


@pytest.mark.parametrize("hot", [0, 3])
def test_windows_of_hot_anchors(docs, odd, rows, hot):
    """Cutting all anchors' pieces (or those of anchors found over three times) into windows changes nothing."""
    assert {r[0]: tuple(r)[1:] for r in bytes_of(docs, hot).collect()} == brute_bytes([r[:2] for r in rows])
    assert sorted(map(tuple, words_of(odd, hot).collect()), key=str) == brute_words([(r.doc_id, r.text) for r in odd.collect()])


def test_words_of_repeated_and_null_ids(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, words_of(odd).collect()), key=str) == brute_words(rows)


def test_bytes_of_repeated_and_null_ids(odd):
    """Null ids come first of all; rows that share an id are judged one by one against those of smaller ids."""
    rows = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in odd.collect()]
    expected = []
    for d, t in rows:
        before = [(-2, x) for e, x in rows if e < d]
        expected.append((d, *brute_bytes([*before, (d, t)])[d]))
    got = [((-1 if r.doc_id is None else r.doc_id), *tuple(r)[1:]) for r in bytes_of(odd).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_equal_hashes_of_different_bytes_stay_apart():
    """Pieces whose content hashes are all made equal are joined by their bytes alone."""
    texts = [b"x" * 60, b"y" * 60, b"x" * 60, b"z" * 61, b"x" * 60, b"y" * 60]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    n, zero = len(texts), np.zeros(len(texts), np.uint64)
    p = _repeats.Pieces(np.arange(n), np.arange(n), np.zeros(n, np.int64), size, zero, zero, zero, np.cumsum(size) - size, size, data)
    stay, gone = _repeats.join_equal(p, True)
    assert gone[0].tolist() == [2, 4] and sorted(stay.address.tolist()) == [0, 1, 3, 5]
    by, group = _repeats._heads(p)
    assert all(texts[i] == texts[j] for i, g in zip(by, group, strict=True) for j, h in zip(by, group, strict=True) if g == h)


def test_empty(empty):
    assert bytes_of(empty).count() == 0 and words_of(empty).count() == 0


def test_shards_are_merged_by_bisection(rows):
    """Small shards give what one large shard gives."""
    texts = [(t or "").encode() for _, t, *_ in rows if t and len(t) > 50][:12]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    n = len(texts)
    one = np.zeros(n, np.uint64)
    p = _repeats.Pieces(np.arange(n), np.arange(n), np.zeros(n, np.int64), size, one, one, one, start, size, data)

    def cover(shard):
        found = set()
        for a, i, j in zip(*suffix_array.resolve(p, shard=shard), strict=True):
            found |= {(int(a), x) for x in range(int(i), int(j))}
        return found

    assert cover(1 << 30) == cover(600) == cover(1)


@pytest.mark.parametrize("trial", range(20))
def test_suffix_array_and_prefixes(trial):
    rng = np.random.default_rng(trial)
    pieces = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 60)).astype("u1")) for _ in range(rng.integers(1, 6))]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(x) for x in pieces])
    end = np.repeat(np.cumsum(size), size)
    order, rank = suffix_array.suffix_array(data, end)
    suffix = [data[i : end[i]].tobytes() for i in range(len(data))]
    assert list(order) == sorted(range(len(data)), key=lambda i: (suffix[i], i)) and (rank[order] == np.arange(len(data))).all()
    prefix = suffix_array.common_prefixes(data, end, order, rank, 9, lanes=3)
    for a, b in zip(order[:-1], order[1:], strict=True):
        same = next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), min(len(suffix[a]), len(suffix[b])))
        assert prefix[b] == min(same, 9)


def test_groups_by_prefix_hold_whole_subtrees():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, 4000).astype(np.int32)
    words[2000:2400] = words[:400]
    suffixes = np.arange(4000 - 12)
    groups = suffix_tree.prefix_groups(words, suffixes, 100, 12)
    assert sorted(np.concatenate(groups).tolist()) == suffixes.tolist() and max(map(len, groups)) <= 100
    repeated = set()
    for g in groups:
        leaves, parts = suffix_tree.subtree(words, g, 12)
        node = suffix_tree.deep_nodes(parts, 12)
        repeated |= set(leaves[np.bincount(node)[node] > 1].tolist())
    counts = Counter(tuple(words[i : i + 12]) for i in suffixes)
    assert repeated == {i for i in suffixes.tolist() if counts[tuple(words[i : i + 12])] > 1}


def test_hash_is_sparks(spark):
    x = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 200)
    got = [r[0] for r in spark.createDataFrame([(int(v),) for v in x], "a long").select(F.xxhash64("a")).collect()]
    assert got == _repeats.xxhash64(x).tolist()


def test_op6_sql(spark, sf, duck, same_rows):
    same_rows(suffix_tree.op6_suffix_tree(spark, sf).toPandas(), duck.execute(OP6_SQL).df())


def test_op4_sql(spark, sf, duck, same_rows):
    same_rows(suffix_array.op4_suffix_array(spark, sf).toPandas(), duck.execute(OP4_SQL).df())
