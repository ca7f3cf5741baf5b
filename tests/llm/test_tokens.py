"""BPE, the range coder and token files."""

import base64
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from voltaic.llm import bpe, rangecoder, tokenfiles

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktokens(reference):
    rnd = random.Random(0)
    texts = ["".join(rnd.choice("ab cé\n\t　漢字12's😀ÀA|<%") for _ in range(rnd.randint(0, 200))) for _ in range(500)]
    texts += ["a" * 3000, "ab" * 2000, " " * 1000 + "x", "é" * 1000, "".join(rnd.choice("abcdefghij") for _ in range(8000)), "\x1c\x1d a\x85b​", ""]
    mine = bpe.tokenizer(PATH, P.PATTERN)
    for t in texts:
        ids = mine.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t) and mine.decode(ids) == t.encode()


def test_rank_order_with_lower_rank_made_by_a_merge(tmp_path):
    """A merge may make a pair that comes before the rest of its bucket."""
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"ab": 5, b"aba": 1, b"abab": 2}
    (tmp_path / "r").write_bytes(b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in ranks.items()))
    theirs = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    mine = bpe.ByteBPE(str(tmp_path / "r"), r"\S+")
    for t in ("abab", "ababab", "abaabab", "bababa"):
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == theirs.encode_ordinary(t)


def test_pretokens_merged_together(reference, tmp_path, monkeypatch):
    """Repeats, long runs, pre-tokens in which a merge makes a lower rank, and bytes without a token, in small groups."""
    monkeypatch.setattr(bpe, "TOGETHER", 1)
    monkeypatch.setattr(bpe, "GROUP", 4000)
    monkeypatch.setattr(bpe, "MERGED", 300)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab cé\n\t　漢字12's😀ÀA|<%") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += ["".join(rnd.choice(["er", "in", "st", "on", "é", " ", "qu", "a"]) for _ in range(400)) for _ in range(50)] * 2
    texts += ["a" * 3000, "ab" * 2000, "é" * 1001, "", "".join(rnd.choice("abcdefghij") for _ in range(8000))]
    mine = bpe.ByteBPE(PATH, P.PATTERN)
    ids = list(mine.encode_all(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert len(mine.keys) and not mine.queue.buckets and mine.queue.first() < 0
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"ab": 5, b"aba": 1, b"abab": 2}
    for name, given in (("all", ranks), ("few", {k: v for k, v in ranks.items() if k != b"z"})):
        (tmp_path / name).write_bytes(b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in given.items()))
        theirs = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        texts = ["abab ababab abaabab", "bababa xababab", "".join(rnd.choice("abc ") for _ in range(500))]
        got = bpe.ByteBPE(str(tmp_path / name), r"\S+").encode_all(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[i for w in t.split() for i in theirs.encode_ordinary(w)] for t in texts]


def test_queue_gives_ranks_in_order():
    rnd = random.Random(1)
    q, ranks = bpe.RankQueue(200_000), [rnd.randrange(200_000) for _ in range(500)]
    for i, r in enumerate(ranks):
        q.push(r, i)
    out = []
    while (r := q.first()) >= 0:
        out += [r] * len(q.take(r))
    assert out == sorted(ranks)


def test_documents(docs, odd, empty, rows, reference):
    encoded = bpe.encode(docs, PATH, P.PATTERN)
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()}
    assert ids == {i: reference.encode_ordinary(t or "") for i, t, *_ in rows}
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(encoded, PATH, P.PATTERN).collect()} == {i: (t or "").encode() for i, t, *_ in rows}
    for table in (odd, empty):
        got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(table, PATH, P.PATTERN).collect()), key=str)
        expected = []
        for r in table.collect():
            own = reference.encode_ordinary(r.text or "")
            expected.append((r.doc_id, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert got == sorted(expected, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 300, 5000, 60_000])
@pytest.mark.parametrize("alphabet", [2, 300, 49_408])
def test_blocks_come_back(n, alphabet):
    x = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, alphabet - 1)
    raw = rangecoder.encode_block(x, alphabet)
    y, end = rangecoder.decode_block(b"__" + raw, 2)
    assert end == len(raw) + 2 and (x == y).all()


def test_coder_learns_and_finds_damage():
    x = np.tile(np.arange(40), 2000)
    raw = rangecoder.encode_block(x, 50_000)
    assert len(raw) < len(x) // 8
    with pytest.raises(ValueError, match="damaged"):
        rangecoder.decode_block(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_files(spark, docs, odd, empty, rows, tmp_path):
    path = P.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    manifest = tokenfiles.write_tokens(docs, f"file://{tmp_path}/a", path, 1)
    got = {r.doc_id: r for r in tokenfiles.read_tokens(manifest).collect()}
    start = 0
    for i, t, *_ in rows:
        ids = np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    again = tokenfiles.read_tokens(tokenfiles.write_tokens(odd, f"file://{tmp_path}/b", path, 1), ids=False).collect()
    expected, start = [], 0
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode())):
        own = np.array([*theirs.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((r.doc_id, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(map(tuple, again), key=lambda r: r[1]) == expected
    assert tokenfiles.read_tokens(tokenfiles.write_tokens(empty, f"file://{tmp_path}/c", path, 1)).count() == 0


def test_words_of_special_cases():
    tool = tokenfiles.WordTokenizer(P.path("word_bpe_49k.json"))
    tm = "a"
    while len(tm) < 1024:
        tm += tm.translate(str.maketrans("ab", "ba"))
    texts = [f"{tm} {tm.translate(str.maketrans('ab', 'ba'))}", "Aİ. İ! xİ, İ", "İstanbul It's x.y. don't Ünïted été, ΑΣ. <|endoftext|> a<|startoftext|>b", "A B. C, 12 3! ﬁn ǅ  x　y", None, ""]
    for _ in range(2):  # learned, and then known
        raw = [(t or "").encode() for t in texts]
        ids, counts = tool.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 1)
        assert np.split(ids, np.cumsum(counts))[-1].size == 0
        for t, own in zip(texts, np.split(ids, np.cumsum(counts)), strict=False):
            assert own.tolist() == [*tool.tool.encode(t or "", add_special_tokens=False).ids, 1]


def test_tokenizers_that_look_past_words_are_refused(tmp_path):
    steps = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))
    for change in ({"normalizer": {"type": "Prepend", "prepend": "_"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        (tmp_path / "t.json").write_text(json.dumps(steps | change))
        with pytest.raises(ValueError, match="on their own"):
            tokenfiles.WordTokenizer(str(tmp_path / "t.json"))
