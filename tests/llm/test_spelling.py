"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from voltaic.llm import spelling


def brute_vocabulary(rows):
    count = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_vocabulary(rows)
    found = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, str(form[w]), root, n[w], len(found[w]), str(n.get(form[w]))))
    return sorted(out)


def result(df):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in df.collect())


def test_documents(docs, odd, empty, rows):
    assert result(spelling.variants(docs)) == brute_variants([(r[0], r[1]) for r in rows])
    assert result(spelling.variants(odd)) == brute_variants([(r.doc_id, r.text) for r in odd.collect()])
    assert spelling.variants(empty).count() == 0


def test_misspelt_words(spark):
    """Chains of forms, ties, runs of equal letters, letters beyond ASCII and words that differ at every place."""
    rnd = random.Random(11)
    base = ["committee", "bookkeeper", "aaaaaaaa", "étéétéét", "Àbcdefg÷", "necessary", "mississippi"]
    letters = "aekmstéÀÿ"
    weights, texts = {}, []
    for w in base:
        weights[w] = rnd.choice([1500, 900])
        for depth, times in ((1, 60), (2, 5), (3, 2)):
            for _ in range(12):
                v = w
                for _ in range(depth):
                    i = rnd.randrange(len(v))
                    v = rnd.choice([v[:i] + v[i + 1 :], v[:i] + rnd.choice(letters) + v[i:], v[:i] + rnd.choice(letters) + v[i + 1 :]])
                weights[v] = times
    pool = [w for w, n in weights.items() for _ in range(n)]
    rnd.shuffle(pool)
    for i in range(0, len(pool), 50):
        texts.append((i, " ".join(w.title() if rnd.random() < 0.1 else w for w in pool[i : i + 50])))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    got = result(spelling.variants(df))
    assert got == brute_variants(texts)
    assert any(f != "None" and r != f for _, f, r, *_ in got)


def test_a_very_long_word_costs_its_length(spark):
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefgh") for _ in range(100_000))
    texts = [(i, f"{long} {long[:500]}x{long[501:]} {long}") for i in range(2)]
    got = result(spelling.variants(spark.createDataFrame(texts, "doc_id bigint, text string")))
    want = brute_vocabulary(texts)
    assert {w: n for w, _, _, n, *_ in got} == want
    assert {w: k for w, _, _, _, k, _ in got} == {w: sum(near(w, x) for x in want) for w in want}
