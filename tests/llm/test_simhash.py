"""SimHash fingerprints and their links, against brute force."""

import random
import re

import numpy as np
import xxhash

from voltaic.llm import simhash


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """The least id of each position's component; prints: (id, fingerprint)."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(prints))]


def check(df, given):
    rows = df.collect()
    prints = [(i, brute_print(t)) for i, t in given]
    want = sorted((str(i), f"{f:016x}", str(c)) for (i, f), c in zip(prints, brute_components(prints), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want


def test_documents(spark, docs, odd, empty, rows):
    check(simhash.near_duplicates(docs), [(r[0], r[1]) for r in rows])
    check(simhash.near_duplicates(odd), [(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_duplicates(empty).count() == 0


def test_spark_has_the_same_hash(spark):
    text = "Some words é of a shingle that is longer than thirty-two bytes"
    assert spark.range(1).selectExpr(f"xxhash64('{text}') as h").first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_links_of_made_fingerprints(spark):
    """Clusters, chains, hot segments and pairs at distances 1 to 3, in every segment."""
    rnd = random.Random(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        p = rnd.getrandbits(64)
        prints.add(p)
        for _ in range(rnd.randrange(5)):  # chains
            for _ in range(rnd.randint(1, 3)):
                p ^= 1 << rnd.randrange(64)
            prints.add(p)
    high = rnd.getrandbits(32) << 32
    prints |= {high | rnd.getrandbits(12) for _ in range(500)}  # one segment, closely packed
    low = rnd.getrandbits(32)
    prints |= {rnd.getrandbits(14) << 40 | low for _ in range(300)}
    prints = sorted(prints)
    fp = np.array(prints, np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in fp], "fp bigint").repartition(5)
    edges = simhash.links(nodes).collect()
    at = {int(x): i for i, x in enumerate(fp)}
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for e in edges:
        up[root(at[e.a])] = root(at[e.b])
    got = [root(i) for i in range(len(prints))]
    want = brute_components(list(enumerate(prints)))
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
    assert len(edges) < 50 * len(prints)


def test_long_text_and_one_word():
    text = " ".join(f"w{i % 977}" for i in range(200_000))
    assert simhash.fingerprint(text.encode()) == brute_print(text)
    assert simhash.fingerprint(b"x" * 100_000) == xxhash.xxh64_intdigest(b"x" * 100_000, 42)
    assert simhash.fingerprint("Ä B".encode()) == xxhash.xxh64_intdigest("Ä b".encode(), 42)
