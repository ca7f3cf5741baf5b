"""The Jaccard join and the pipeline against brute force."""

import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from voltaic.llm import bpe, decontamination, jaccard, quality, secrets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_classes(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.fixture(scope="module")
def near(spark):
    """Bases with edits around the threshold, a large group of near copies, and texts that share passages."""
    rng = np.random.default_rng(4)
    out = []
    passage = [f"p{i}" for i in range(60)]
    for base in range(12):
        words = [f"w{rng.integers(5000)}" for _ in range(int(rng.choice([6, 12, 25, 40, 90, 200, 400])))]
        for _ in range(int(rng.integers(2, 9))):
            w = list(words)
            for _ in range(int(rng.integers(0, 1 + len(w) // 30 + 1))):
                w[rng.integers(len(w))] = f"e{rng.integers(10**6)}"
            out.append(" ".join(w))
        out.append(" ".join(passage + words[:20]))
    for _ in range(60):
        out.append(" ".join(passage + [f"u{rng.integers(10**6)}" for _ in range(int(rng.integers(1, 40)))]))
    rows = list(enumerate(out))
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize(("k", "percent", "level"), [(4, 85, 1), (5, 80, 1), (4, 85, 2)])
def test_classes(near, k, percent, level):
    rows, df = near
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(df, k, percent, level=level).collect()}
    assert got == brute_classes(rows, k, percent)


def test_blocks_of_groups(near, monkeypatch):
    rows, df = near
    monkeypatch.setattr(jaccard, "PAIR_BLOCK", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(df, 4, 85).collect()}
    assert got == brute_classes(rows, 4, 85)


def brute_rows(rows, k, percent):
    """(doc_id, set size, component) of rows whose ids may be null or shared: rows are the nodes."""
    by_row = brute_classes([(i, t) for i, (_, t) in enumerate(rows)], k, percent)
    parts = {}
    for i, (d, _) in enumerate(rows):
        n, c = by_row[i]
        if n:
            copies = next(j for j in range(len(rows)) if by_row[j] == (n, c) or by_row[j][1] == c)
            parts.setdefault(by_row[copies][1], []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        n, c = by_row[i]
        ids = [x for x in parts.get(c, []) if x is not None] if n else [d]
        out.append((d, n, min(ids) if ids else None))
    return sorted(out, key=str)


def test_odd_tables(docs, odd, empty, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs, 4, 85).collect()}
    assert got == brute_classes([r[:2] for r in rows], 4, 85)
    assert sorted(map(tuple, jaccard.similarity_classes(odd, 4, 85).collect()), key=str) == brute_rows([(r.doc_id, r.text) for r in odd.collect()], 4, 85)
    assert jaccard.similarity_classes(empty, 4, 85).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_null_and_shared_ids_link(spark):
    """A text without an id bridges two others; of two texts under one id each has its own links."""
    words = [f"w{i}" for i in range(60)]

    def changed(text, *at):
        return " ".join(f"x{i}" if i in at else w for i, w in enumerate(text.split()))

    one, other = " ".join(words), " ".join(reversed(words))
    chain = [(1, one), (None, changed(one, 0)), (2, changed(one, 0, 59)), (None, "alone without any id at all")]
    shared = [(5, other), (5, "quite another text that has the same id as one above it"), (6, changed(other, 0)), (7, "quite another text that has the same id as one above it")]
    rows = chain + shared
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, jaccard.similarity_classes(df, 4, 85).collect()), key=str)
    assert got == brute_rows(rows, 4, 85)
    assert {(d, c) for d, _, c in got} >= {(1, 1), (2, 1), (None, 1), (6, 5), (7, 5), (None, None)}
    kept = sorted(map(tuple, jaccard.keep_one(df, 4, 85).collect()), key=str)
    assert kept == sorted([chain[0], chain[3], shared[0], shared[1]], key=str)


def test_no_link_by_made_up_words(spark):
    """Words whose letters make sums of powers of one number collide (a Thue-Morse word and its complement) are different words."""
    tm = "a"
    while len(tm) < 1024:
        tm += tm.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{tm} one two three four"), (2, f"{tm.translate(str.maketrans('ab', 'ba'))} one two three four")]
    got = {r.doc_id: r.component_id for r in jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()}
    assert got == {1: 1, 2: 2}


@pytest.mark.parametrize("level", [1, 2])
@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(level, percent):
    rng = np.random.default_rng(level)
    for size in [3, 6, 7, 9, 13, 20, 33, 50, 121, 300]:
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for _ in range(20):
            drop = rng.integers(0, max(1, size * (100 - percent) // 100) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, 3)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both) or len(a) == len(b) == both:
                continue
            row = np.repeat([0, 1], [len(a), len(b)])
            who, sig = jaccard.signatures(row, np.concatenate([a, b]), np.array([len(a), len(b)]), percent, level)
            assert set(sig[who == 0]) & set(sig[who == 1])


@pytest.mark.parametrize("level", [1, 2, 3])
@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_sparse_linked_sets_share_a_signature(level, percent):
    """Sets of all sizes, differing as far as links go, whose shingles leave more or fewer cells empty."""
    rng = np.random.default_rng(percent + level)
    for trial in range(600):
        size = int(rng.choice([rng.integers(2, 40), rng.integers(40, 400), rng.integers(400, 1500)]))
        top = int(rng.choice([1 << 63, 1 << 61, 1 << 58])) * 2
        draw = lambda n: np.unique(rng.integers(0, top - 1, n, dtype=np.uint64))  # noqa: B023, E731
        a = draw(size)
        most = (len(a) * (100 - percent)) // percent
        lost = int(rng.integers(0, most + 1)) if trial % 2 else 0
        b = np.union1d(rng.permutation(a)[lost:], draw(max(0, int(rng.integers(0, most + 2)) - lost)))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < percent * (len(a) + len(b) - both) or len(a) == len(b) == both:
            continue
        who, sig = jaccard.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.array([len(a), len(b)]), percent, level)
        assert set(sig[who == 0]) & set(sig[who == 1])


def test_unrelated_sets_share_no_signature():
    """Else groups of chance would grow with the corpus, and pairs with its square."""
    rng = np.random.default_rng(2)
    size = rng.integers(250, 420, 1500)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in size]
    who, sig = jaccard.signatures(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), np.array([len(s) for s in sets]), 80)
    assert len(np.unique(who)) == len(sets)
    assert len(np.unique(sig)) == len(np.unique(np.column_stack([who.astype(np.uint64), sig]), axis=0))


def test_near_pairs_are_those_of_different_labels(monkeypatch):
    """Against brute force, in groups with one side or two."""
    rng = np.random.default_rng(3)
    n = 400
    group, label = np.sort(rng.integers(0, 12, n)), rng.integers(0, 4, n) * 10**17
    side = np.where(group % 2 == 0, 0, rng.integers(1, 3, n))
    by = np.lexsort((label, side, group))
    group, side, label = group[by], side[by], label[by]
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(n)]
    size = np.array([len(x) for x in sets])
    sketches = jaccard.Sketches(size, jaccard.sketches_of(np.repeat(np.arange(n), size), np.concatenate(sets), size))
    looked, near = [], sketches.near
    monkeypatch.setattr(jaccard, "PAIRS", 100)
    monkeypatch.setattr(sketches, "near", lambda i, j, percent: (looked.extend(zip(i.tolist(), j.tolist(), strict=True)), near(i, j, percent))[1])
    i, j, distance = jaccard.near_pairs(group, side, label, sketches, 60)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if group[a] == group[b] and label[a] != label[b] and (side[a] == 0 or side[a] < side[b])]
    assert sorted(looked) == pairs
    found, bits = near(*(np.array(x) for x in zip(*pairs, strict=True)), 60)
    assert 0 < len(found) < len(pairs)
    assert sorted(zip(i.tolist(), j.tolist(), distance.tolist(), strict=True)) == [(*pairs[f], d) for f, d in zip(found.tolist(), bits.tolist(), strict=True)]


def test_first_edges_lead_to_the_nearest(spark):
    """A node is compared first with the one it shares most signatures with, not with any that it meets by a passage."""
    rows = [(1, 10, 1), (1, 30, 1), (2, 20, 7), (2, 30, 7), (3, 20, 1), (3, 30, 1), (3, 40, 1)]
    groups = spark.createDataFrame(rows, "group bigint, node bigint, weight bigint")
    assert sorted(map(tuple, jaccard._first_edges(groups.withColumn("label", groups.node)).collect())) == [(20, 30), (20, 40)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (55, 60)], "a bigint, b bigint")
    assert {r.node: r.label for r in jaccard.components(edges).collect()} == {i: 1 for i in range(1, 41)} | {50: 50, 55: 50, 60: 50}


def test_pipeline_by_hand(spark, sf):
    """The stages one by one, each on what brute force or a simpler form of the operator leaves."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    texts = {d: texts[d] for d, (_, c) in brute_classes(list(texts.items()), 5, 80).items() if c == d}
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = word.findall((r.text or "").encode().lower())
        n = min(len(w), decontamination.WINDOW)
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    clean = {}
    for d, t in texts.items():
        w = word.findall((t or "").encode().lower())
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            clean[d] = t
    rules, tool = secrets.compiled(), bpe.tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    expected = {}
    for (d, t), spans in zip(clean.items(), secrets.find_secrets([(t or "").encode() for t in clean.values()], rules), strict=True):
        raw, parts, end = (t or "").encode(), [], 0
        for a, b, _ in spans:
            if a >= end:
                parts += [raw[end:a], b"[REDACTED]"]
            end = max(end, b)
        raw = b"".join([*parts, raw[end:]])
        ids = tool.encode(raw.decode())
        expected[d] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, sf).collect()} == expected


def test_stages_keep_columns_of_odd_tables(spark, sf, docs, odd, empty):
    for table in (docs, odd, empty):
        for _, step in corpus_pipeline.STAGES[:-1]:
            assert step(spark, table, sf).columns == table.columns
            step(spark, table, sf).count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() == table.count()
