"""Secrets, decontamination, quality, sharding and toxicity."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from voltaic.llm import automaton, decontamination, quality, secrets, sharding, toxicity

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
OTHERS = {"access": (re.compile(r"AKIA[A-Z0-9]+"), 20), "hex": (re.compile(r"[0-9a-f]+"), 24)}


def brute_secrets(text):
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for kind, (pattern, least) in OTHERS.items():
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m[0]) >= least]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_base_spans_of_random_texts():
    rnd = random.Random(2)
    parts = ["token", "secret", "ToKen", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "abcdefgh", "\n", "AKIA", "AKIA" + "Q" * 16, "0123456789abcdef01234567", "x.y", "passwd", "é", "ghp_" + "a" * 36]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    rules = secrets.compiled()
    for text, spans in zip(texts, secrets.find_secrets([t.encode() for t in texts], rules), strict=True):
        assert [s for s in secrets._points(text, spans) if s[2] in secrets.BASE] == brute_secrets(text)


def test_secrets_of_documents(docs, odd, empty, rows):
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.secrets] for r in secrets.secret_scan(docs).collect()}
    assert len(found) == len(rows)
    for i, text, *_ in rows:
        assert [s for s in found[i] if s[2] in secrets.BASE] == brute_secrets(text or "")
    assert secrets.secret_scan(odd).count() == odd.count() and secrets.secret_scan(empty).count() == 0
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert all((clean[i] == t) == (not found[i]) for i, t, *_ in rows) and not any(brute_secrets(t or "") for t in clean.values())


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "[a-c]{2,3}x?", "(ab|a)(c|bcd)", "x{2}", r"\x41+[^b]".replace("[^b]", "b")])
def test_automaton_is_the_pattern(pattern):
    a = automaton.compile_rules([automaton.parse(pattern)], anchored=True)
    rnd = random.Random(0)
    for _ in range(500):
        text = "".join(rnd.choice("abcdxA") for _ in range(rnd.randint(0, 6)))
        state = 0
        for b in text.encode():
            state = a.by_byte[state, b]
        assert bool(a.ends[state]) == bool(re.fullmatch(pattern, text))


def brute_hits(rows, items):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").encode().lower())
    windows = []
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        windows += [(str(item), w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    out = {}
    for d, text in rows:
        w = words(text)
        hit, found = [False] * len(w), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit[i : i + len(x)] = [True] * len(x)
                    found.add(item)
        out[d] = (len(w), sum(hit), sorted(found))
    return out


def summary(df):
    return {r.doc_id: (r.n_words, sum(h.end - h.start for h in r.hits), sorted(r["items"])) for r in df.collect()}


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination(spark, docs, empty, rows, block):
    text = rows[7][1]
    cut = " ".join(text.upper().split()[25:60])
    items = [(1, cut), (2, cut + " more"), (3, "two, WORDS"), (4, None), (5, ""), (6, "nowhere at all in any of these documents is this to be found"), (7, "one")]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, doc_id int")
    assert summary(decontamination.find_contamination(docs, benchmark, block_bytes=block)) == brute_hits([r[:2] for r in rows], items)
    clean = {r.doc_id for r in decontamination.decontaminate(docs, benchmark, block_bytes=block).collect()}
    assert clean == {d for d, (_, n, _) in brute_hits([r[:2] for r in rows], items).items() if not n}
    assert decontamination.find_contamination(empty, benchmark, block_bytes=block).count() == 0
    assert summary(decontamination.find_contamination(docs, benchmark.limit(0), block_bytes=block))[7][1:] == (0, [])


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_decontamination_of_odd_tables(spark, odd, block):
    """Rows that repeat and null ids are rows of their own, with one block of the benchmark as with several."""
    text = " ".join(odd.where("doc_id = 7").first().text.split()[25:60])
    items = [(1, text), (2, "two, WORDS"), (None, "one"), (3, "not here, but in a block of its own all the same, as it is long enough for that")]
    found = decontamination.find_contamination(odd, spark.createDataFrame(items, "item_id int, text string"), block_bytes=block)
    got = sorted(((r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), tuple(sorted(r["items"]))) for r in found.collect()), key=str)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    brute = brute_hits(list(enumerate(t for _, t in rows)), [("null" if i is None else i, t) for i, t in items])
    assert got == sorted(((d, n, hit, tuple(x)) for (d, _), (n, hit, x) in zip(rows, (brute[i] for i in range(len(rows))), strict=True)), key=str)


def test_equal_hashes_are_no_hit(spark, monkeypatch):
    """With every word hashed alike, the words themselves decide."""
    monkeypatch.setattr("voltaic.llm._words.word_hashes", lambda data, start, end, seed: np.full(len(start), 7, np.uint64))
    block = decontamination.make_block([(1, "one two three four five six seven eight nine ten")])
    data = np.frombuffer(b"a b c d e f g h i j k - One, two three four five six seven eight nine TEN l m", np.uint8)
    w = decontamination._words(data, np.array([0, len(data)]), 0)
    prefixes = decontamination._prefixes(block, {s: (np.unique(block.shingles(s)[0]), np.ones(1, np.int64)) for s in (1, 2, 3)})
    hits = [(int(a), int(v)) for start, window in decontamination._hits(w, data, block, prefixes) for a, v in zip(start, window, strict=True)]
    assert hits == [(11, 0)]


def test_op5_sql(spark, sf, duck, same_rows):
    same_rows(decontamination.op5_decontamination(spark, sf).toPandas(), duck.execute(decontamination.OP5_SQL).df())


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    counts = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if counts[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, odd, empty, rows):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, text, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text)
        assert not (r.kept and r.base_failed) and (r.kept or r.base_failed or r.soft_failed)
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.quality_rules(odd).count() == odd.count() and quality.quality_rules(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_bad_hosts_lose_what_fails_softly(spark):
    junk = " ".join(f"w{i}##########" for i in range(20))
    good = " ".join(f"word{i}" for i in range(20))
    rows = [(i, junk if host == "bad" or i % 20 == 0 else good, host) for i, host in enumerate(["bad"] * 40 + ["good"] * 200)] + [(999, good, "bad")]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert not any(got[i] for i in range(40)) and all(got[i] for i in range(40, 240)) and got[999]


def test_op3_sql(spark, sf, duck, same_rows):
    same_rows(quality.op3_quality_rules(spark, sf).toPandas(), duck.execute(quality.OP3_SQL).df())


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(docs, odd, empty, rows, shards):
    got = sharding.interleave(docs, shards).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    mix = got.groupby(["source", "shard"], dropna=False).size().unstack(fill_value=0)
    assert (mix.max(axis=1) - mix.min(axis=1)).max() <= 3
    assert got.set_index("doc_id")["size"].to_dict() == {i: len((t or "").encode()) + 1 for i, t, *_ in rows}
    assert sharding.interleave(odd, shards).count() == odd.count() and sharding.interleave(empty, shards).count() == 0


def test_sharding_by_brute_force(docs, odd):
    """Ranks by sorting all rows in Python; rows alike in all that is looked at may change places."""
    for table in (docs, odd):
        got = sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in sharding.interleave(table, 8).collect())
        rows = [(r.doc_id, r.source, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in table.collect()]
        hashed = table.sparkSession.createDataFrame(rows, "doc_id bigint, source string, size bigint, crc bigint")
        rows = [(r[0] % 2**64 // 2, *r[1:]) for r in hashed.select(F.xxhash64(F.lit(42), "doc_id", "size", "crc"), "doc_id", "source", "size", "crc").collect()]
        low = -(1 << 63)
        ranked, of = [], Counter(r[2] for r in rows)
        for source in of:
            mine = sorted((r for r in rows if r[2] == source), key=lambda r: (r[0], low if r[1] is None else r[1], r[4]))
            ranked += [((k + 0.5) / of[source], (source is not None, source or ""), r) for k, r in enumerate(mine)]
        ranked.sort(key=lambda x: (x[0], x[1], x[2][0], low if x[2][1] is None else x[2][1], x[2][4]))
        n = len(ranked)
        expected = sorted((str(r[1]), r[3], r[4], k * 8 // n, k - -(-(k * 8 // n) * n // 8)) for k, (_, _, r) in enumerate(ranked))
        assert got == expected


def test_gains_by_brute_force():
    """Scores from lengths that are made anew with plain zstandard calls."""
    rng = np.random.default_rng(2)
    word = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "r", "st", "ll")]

    def text(n, *more):
        return " ".join([*rng.choice(word, n), *more]).encode()

    toxic = [text(30, "vilestuff", "nastyword") for _ in range(40)]
    model = toxicity.fit(toxic, [text(30) for _ in range(120)], 0.25)
    tools = [zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for d in (model.ordinary, model.toxic)]
    for t in (toxic[0], text(50), b"", b"x" * 200, text(3, "nastyword")):
        windows = [w[i : i + 64] for w in t.lower().split() for i in range(0, len(w), 64)]
        gains = [len(tools[0].compress(b" " + w + b" " * 13)) - len(tools[1].compress(b" " + w + b" " * 13)) for w in windows]
        counts = np.array([sum(g >= least for g in gains) for least in toxicity.GAINS])
        assert np.allclose(model.features(t), [*np.log1p(counts), *np.sqrt(counts / max(1, len(windows))), np.log1p(len(windows))])
    scores = [model.score(np.array([model.features(t)]))[0] for t in (text(40, "nastyword", "vilestuff"), text(40))]
    assert scores[0] > toxicity.THRESHOLD > scores[1]


def test_sharding_is_the_same_again(docs):
    a, b = (sorted(map(tuple, sharding.interleave(x, 4).collect()), key=str) for x in (docs, docs.repartition(7)))
    assert a == b


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = toxicity.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    order = out["score"].rank()
    ones = int(out["toxic"].sum())
    auc = (order[out["toxic"] == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(out) - ones))
    assert auc > 0.75 and out["score"].between(0, 1).all() and out[out["predicted"] == 1]["toxic"].mean() > 0.7


def test_toxicity_of_odd_tables(spark, docs, odd, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)] + [(None, 0, 1), (5, 0, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    for table in (docs, odd, empty):
        scores = [r.score for r in toxicity.score_toxicity(table, model).collect()]
        assert len(scores) == table.count() and all(0 <= s <= 1 for s in scores)
    nothing = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.score < 1e-6 for r in toxicity.score_toxicity(docs, nothing).collect()} == {True}
    assert toxicity.score_toxicity(docs, model).select(F.count("score")).first()[0] == docs.count()
    assert np.isfinite(model.weights).all()
