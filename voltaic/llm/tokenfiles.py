"""Token-id files: texts as ids of a ``tokenizers`` file, in context-mixed, range-coded, checksummed blocks.

``write_tokens`` sorts documents by id over range partitions; each task writes one file into a folder that all executors see:

    blocks of ``rangecoder`` (independent of each other, each with its own CRC-32), ids of all its documents in a row
    index: zlib of one validity byte, one 64-bit id and one 64-bit count of ids for each document
    footer: <4s magic, Q documents, Q ids, Q place of the index, I CRC-32 of the index>

and returns a manifest, a row per file in ascending order of ids, with the ids of all files before it. A task that runs
again writes another file; the manifest names that of the attempt that ended well. ``read_tokens`` reads files back, each on its own.

Words between white space are encoded on their own, each distinct one once by the library, and found again by hashes that every worker
keys by a number of its own. That gives the ids of whole texts for tokenizers whose file says that no step looks past white space (see
``WordTokenizer``); others are refused. Nulls and empty texts have the end id alone. Ids of documents are integers; null ids come first.
Rows alike in id are rows of their own, in order of text. An empty table gives no files. Other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import CHUNK, chunks, documents, shared_dir, stage
from ._words import NOT_WHITE, new_seed, split_words
from .rangecoder import BLOCK, decode_block, encode_block

#: Distinct words whose ids a Python worker remembers at most; it bounds memory only.
CACHE = 2_000_000
#: How the vocabulary marks the end of a pre-token, and stops that are pre-tokens of their own after letters.
WORD_END, STOPS = "</w>", ".,;:!?"
_FOOT = struct.Struct("<4sQQQI")
_MAGIC = b"VTF1"
MANIFEST = "part int, path string, docs bigint, ids bigint"


#: Steps of a tokenizer file that act on each word alone. Normalizers that compose, fold case or make runs of white space one space
#: (none joins anything across white space), and a pre-tokenizer whose pieces hold no white space and which drops all else.
NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class WordTokenizer:
    """Ids by the library, word by word. A file with any step that isn't known to act on words alone is refused."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        normalizers = (steps["normalizer"] or {}).get("normalizers", [steps["normalizer"]])
        added = steps["added_tokens"]
        if (
            any(n not in NORMALIZERS for n in normalizers)
            or (steps["pre_tokenizer"] or {}).get("pretokenizers") != PRE_TOKENIZERS
            or steps["post_processor"] or steps["truncation"] or steps["padding"] or steps["model"].get("dropout")
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
        ):
            raise ValueError("this tokenizer is not known to encode words on their own")
        self.tool = Tokenizer.from_file(path)
        self.size = self.tool.get_vocab_size(with_added_tokens=True)
        self.seed = new_seed()
        #: Whether an id ends a pre-token.
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for t, i in self.tool.get_vocab(with_added_tokens=False).items() if t.endswith(WORD_END)]] = True
        self.stops = {c.encode(): self._ids(c) for c in STOPS}
        self._forget()

    def _forget(self) -> None:
        """Known words: hashes in order with each one's number, and by number where its ids begin in ``flat`` and how many there are."""
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0

    def _ids(self, text: str) -> list[int]:
        return self.tool.encode(text, add_special_tokens=False).ids

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words. Those of letters are encoded fifty at a time, one of letters and a stop in two parts, others alone."""
        known: dict[bytes, list[int]] = {}
        plain, stopped, others = {}, [], []
        alone: set[bytes] = set()
        for w in words:
            s = w.decode()
            if s.isalpha():
                plain[w] = s
            elif s[-1] in STOPS and (s := s[:-1]).isalpha():
                stopped.append(w)
                plain[w[:-1]] = s
            else:
                others.append(w)
        keys, values = list(plain), list(plain.values())
        groups = [(keys[i : i + 50], values[i : i + 50]) for i in range(0, len(keys), 50)]
        for (group, _), found in zip(groups, self.tool.encode_batch_fast([" ".join(v) for _, v in groups], add_special_tokens=False), strict=True):
            ids = found.ids
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(group):  # a word of these is more than one pre-token
                others += group
                alone.update(group)
                continue
            begin = 0
            for w, end in zip(group, cuts, strict=True):
                known[w] = ids[begin:end]
                begin = end
        # A stop is a pre-token of its own only after letters that are one; else it may join what is before it.
        others += [w for w in stopped if w[:-1] in alone]
        for w, found in zip(others, self.tool.encode_batch_fast([w.decode() for w in others], add_special_tokens=False), strict=True):
            known[w] = found.ids
        for w in stopped:
            if w not in known:
                known[w] = known[w[:-1]] + self.stops[w[-1:]]
        return [known[w] for w in words]

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        found = self._encode_words(words)
        count = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        first = len(self.count)
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used += len(ids)
        by = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[by])
        self.keys, self.number = np.insert(self.keys, at, hashes[by]), np.insert(self.number, at, first + by)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between ``offsets``, each with the end id, and how many each has. Words go by keyed 64-bit hashes."""
        if len(self.keys) > CACHE:
            self._forget()
        w = split_words(data, offsets, NOT_WHITE, lower=False, seed=self.seed)
        code, distinct = pd.factorize(w.hash)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            seen = np.zeros(len(distinct), np.int64)
            seen[code[::-1]] = np.arange(len(code))[::-1]  # the first place of each
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(w.start[seen[new]].tolist(), w.end[seen[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        number = self.number[at][code]
        count, begin = self.count[number], self.begin[number]
        sums = np.concatenate([[0], np.cumsum(count)])
        per_text = sums[w.first[1:]] - sums[w.first[:-1]] + 1
        out = np.empty(int(per_text.sum()), np.uint32)
        ends = np.cumsum(per_text) - 1
        inner = np.ones(len(out), dtype=bool)
        inner[ends] = False
        out[ends] = end_id
        # Where each id stands in ``flat``: its word's begin, and its place within the word.
        out[inner] = self.flat[np.repeat(begin - sums[:-1], count) + np.arange(sums[-1])]
        return out, per_text


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    return WordTokenizer(path)


def _open(path: str, mode: str):
    """A file by URI, in any store that pyarrow knows."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if mode == "w":
        store.create_dir(os.path.dirname(name), recursive=True)
        return store.open_output_stream(name)
    return store.open_input_file(name)


def _write(path: str, batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> tuple[int, int]:
    """Write one file; its documents and ids. At most a block and a batch are held."""
    tool = _tokenizer(tokenizer)
    waiting: list[np.ndarray] = []
    held = total = at = 0
    ids, valid, counts = [], [], []
    with _open(path, "w") as f:

        def flush(all_of_it: bool) -> None:
            nonlocal waiting, held, at
            if not held:
                return
            joined = np.concatenate(waiting)
            while len(joined) >= BLOCK or all_of_it and len(joined):
                raw = encode_block(joined[:BLOCK], tool.size)
                f.write(raw)
                at += len(raw)
                joined = joined[BLOCK:]
            waiting, held = [joined], len(joined)

        for batch in batches:
            ids.append(batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
            valid.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            for _, _, data, offsets in chunks(batch):
                block, per_text = tool.encode(data, offsets, end_id)
                counts.append(per_text)
                waiting.append(block)
                held += len(block)
                total += len(block)
                if held >= BLOCK:
                    flush(False)
        flush(True)
        if not counts:
            return 0, 0
        n_ids = np.concatenate(counts).astype("<i8")
        index = zlib.compress(np.concatenate(valid).astype("u1").tobytes() + np.concatenate(ids).astype("<i8").tobytes() + n_ids.tobytes(), 1)
        f.write(index + _FOOT.pack(_MAGIC, len(n_ids), total, at, zlib.crc32(index)))
    return len(n_ids), total


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write files of ids under ``folder``; the manifest, with ``start``: ids of all files before."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        path = f"{folder}/part-{part:06d}-{context.taskAttemptId()}.vtf"
        n, ids = _write(path, batches, tokenizer, end_id)
        if n:
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "docs": n, "ids": ids}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    files = stage(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST))
    # A row per file.
    return files.withColumn("start", F.sum("ids").over(Window.orderBy("part")) - F.col("ids"))


def read_file(path: str) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, ids before it in the file, its ids) for each document; blocks are read one by one."""
    with _open(path, "r") as f:
        size = f.size()
        f.seek(size - _FOOT.size)
        magic, n, total, at, crc = _FOOT.unpack(f.read(_FOOT.size))
        f.seek(at)
        index = f.read(size - _FOOT.size - at)
        if magic != _MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"damaged index of {path}")
        index = zlib.decompress(index)
        valid = np.frombuffer(index, "u1", n)
        ids = np.frombuffer(index, "<i8", n, n)
        counts = np.frombuffer(index, "<i8", n, 9 * n)
        f.seek(0)
        held, done = np.zeros(0, "<u4"), 0
        blocks = _blocks(f, at)
        for k in range(n):
            count = int(counts[k])
            while len(held) < count:
                held = np.concatenate([held, next(blocks).astype("<u4")])
            yield (int(ids[k]) if valid[k] else None), done, held[:count].tobytes()
            held, done = held[count:], done + count
        if done != total:
            raise ValueError(f"{path} has {done} ids instead of {total}")


def _blocks(f, end: int) -> Iterator[np.ndarray]:
    from .rangecoder import _HEAD

    at = 0
    while at < end:
        head = f.read(_HEAD.size)
        body = f.read(_HEAD.unpack(head)[4])
        at += len(head) + len(body)
        yield decode_block(head + body)[0]


def read_tokens(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids (binary), a row per document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]
        kinds = [pa.int64()] * 4 + [pa.binary()] * ids
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for doc, before, raw in read_file(path):
                    rows.append((doc, start + before, len(raw) // 4, zlib.crc32(raw), *([raw] if ids else [])))
                    size += len(raw) if ids else 0
                    if len(rows) >= 10_000 or size > CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # A task per file.
    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if ids else ""))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(manifest, ids=False)
