"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of 10 words (a shorter item is one window). A window is the set of its shingles of
three words; a document contains it only if it has all of them, so the window's necessary prefix is its one rarest
shingle, by counts over all documents. Documents are joined with windows on that shingle; the window's place in the document follows
from the shingle's place in the window, must lie within the document (positional and length bounds), and is then verified word
by word and byte by byte.

The benchmark is the query set. It is taken in blocks of ``BLOCK`` bytes of text, each of which is small enough to be sent to
every task; documents pass the blocks one after the other, and each adds its hits to the row.

Nulls and empty texts have no words; an item without words has no windows; an item with a null id goes by "null", and rows
with one id are one item. Repeated documents are rows of their own, however many blocks there are. An empty table gives an empty result or no hits. Columns besides ids and texts are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chunks, documents
from ._words import ALPHANUMERIC, LOWER, Words, new_seed, shingle_hashes, split_words

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 3
#: Bytes of benchmark text that are sent to the tasks at once.
BLOCK = 8 << 20


def _words(data: np.ndarray, offsets: np.ndarray, seed: int) -> Words:
    return split_words(data, offsets, ALPHANUMERIC, lower=True, seed=seed)


def _plain(data: np.ndarray) -> bytes:
    """Texts with a space for every byte that is in no word, as windows are compared: runs of spaces count as one."""
    return np.where(ALPHANUMERIC[data], LOWER[data], np.uint8(32)).tobytes()


@dataclass
class Block:
    """Windows of a block of items: word hashes, each window's start, length, item and words, and the key of the hashes."""

    hashes: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    words: list[bytes]
    names: list[str]
    seed: int

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, window, offset) of the shingles of the windows whose shingles have ``size`` words."""
        mine = np.flatnonzero(np.minimum(self.length, SHINGLE) == size)
        per = self.length[mine] - size + 1
        window = np.repeat(mine, per)
        offset = np.arange(len(window)) - np.repeat(np.cumsum(per) - per, per)
        return shingle_hashes(self.hashes, size)[self.start[window] + offset], window, offset


def make_block(items: list[tuple[object, str | None]], window: int = WINDOW, seed: int = 0) -> Block:
    names = sorted({str(i) if i is not None else "null" for i, _ in items})
    number = {x: k for k, x in enumerate(names)}
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.large_string())], ["text"])
    parts, words = [], []
    base = 0
    for i, _, data, offsets in chunks(batch):
        w = _words(data, offsets, seed)
        owner = np.array([number[str(x) if x is not None else "null"] for x, _ in items[i : i + len(offsets) - 1]], dtype=np.int64)
        n = w.counts()
        length = np.minimum(n, window)[w.row] if len(w) else np.zeros(0, np.int64)
        begins = np.flatnonzero(w.left() >= length)
        plain = _plain(data)
        words += [b" ".join(plain[a:b].split()) for a, b in zip(w.start[begins].tolist(), w.end[begins + length[begins] - 1].tolist(), strict=True)]
        parts.append((w.hash, begins + base, length[begins], owner[w.row[begins]]))
        base += len(w)
    if not parts:
        return Block(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), [], names, seed)
    return Block(*(np.concatenate(x) for x in zip(*parts, strict=True)), words, names, seed)


def _member(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``hashes`` are among the sorted ``keys``, and which key it is. A table of low bits spares most searches."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64((1 << max(16, min(24, len(keys).bit_length() + 4))) - 1)
    table = np.zeros(int(bits) + 1, dtype=bool)
    table[keys & bits] = True
    at = np.flatnonzero(table[hashes & bits])
    key = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
    same = keys[key] == hashes[at]
    return at[same], key[same]


def _frequencies(docs: DataFrame, block: Block) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size of shingle, the block's shingles and how often all documents have them."""
    keys = {size: np.unique(block.shingles(size)[0]) for size in range(1, SHINGLE + 1)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {size: np.zeros(len(k), dtype=np.int64) for size, k in keys.items()}
        for batch in batches:
            for _, _, data, offsets in chunks(batch):
                w = _words(data, offsets, block.seed)
                for size, k in keys.items():
                    if len(k):
                        hashes = shingle_hashes(w.hash, size)
                        at, key = _member(hashes, k)
                        at_row = w.row[at] == w.row[at + size - 1]
                        totals[size] += np.bincount(key[at_row], minlength=len(k))
        for size, t in totals.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size)), pa.array(at), pa.array(t[at])], ["size", "key", "n"])

    # As many rows as the block has shingles at most.
    rows = docs.select("text").mapInArrow(count, "size bigint, key bigint, n bigint").groupBy("size", "key").agg(F.sum("n").alias("n")).toPandas()
    out = {size: (k, np.zeros(len(k), dtype=np.int64)) for size, k in keys.items()}
    for size, part in rows.groupby("size"):
        out[size][1][part["key"].to_numpy()] = part["n"].to_numpy()
    return out


@dataclass
class Prefixes:
    """For one size of shingle: the sorted prefix shingles and, for each, its windows with the shingle's offset."""

    keys: np.ndarray
    begin: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def _prefixes(block: Block, frequencies: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, Prefixes]:
    out = {}
    for size, (keys, counts) in frequencies.items():
        hashes, window, offset = block.shingles(size)
        if not len(hashes):
            continue
        # Rarest first within each window; ties go by hash and then by place.
        order = np.lexsort((offset, hashes, counts[np.searchsorted(keys, hashes)], window))
        first = order[np.unique(window[order], return_index=True)[1]]
        by_key = first[np.argsort(hashes[first], kind="stable")]
        prefix, begin = np.unique(hashes[by_key], return_index=True)
        out[size] = Prefixes(prefix, np.append(begin, len(by_key)), window[by_key], offset[by_key])
    return out


def _hits(w: Words, data: np.ndarray, block: Block, prefixes: dict[int, Prefixes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, window) of verified occurrences: word hashes are compared first, then the words themselves."""
    plain = b""
    for size, p in prefixes.items():
        at, key = _member(shingle_hashes(w.hash, size), p.keys)
        for part in range(0, len(at), 100_000):
            a, k = at[part : part + 100_000], key[part : part + 100_000]
            n = p.begin[k + 1] - p.begin[k]
            which = np.repeat(p.begin[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window, start = p.window[which], np.repeat(a, n) - p.offset[which]
            length = block.length[window]
            # Positional bound: it begins in the text of the shingle. Length bound: that text has words enough from there.
            row = np.repeat(w.row[a], n)
            good = (start >= w.first[row]) & (start + length <= w.first[row + 1])
            window, start, length = window[good], start[good], length[good]
            for i in range(WINDOW):
                ok = (i >= length) | (w.hash[np.minimum(start + i, len(w) - 1)] == block.hashes[np.minimum(block.start[window] + i, len(block.hashes) - 1)])
                window, start, length = window[ok], start[ok], length[ok]
            if len(start):
                plain = plain or _plain(data)
                bounds = zip(w.start[start].tolist(), w.end[start + length - 1].tolist(), window.tolist(), strict=True)
                ok = np.fromiter((b" ".join(plain[x:y].split()) == block.words[v] for x, y, v in bounds), bool, len(start))
                window, start = window[ok], start[ok]
            yield start, window


HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(block: Block, prefixes: dict[int, Prefixes]):
    """Adds to each row (doc_id, text, n_words, hits, items) the ranges of words and the items that the block hits, merged with those it has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = []
            hits, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, _, data, offsets in chunks(batch):
                w = _words(data, offsets, block.seed)
                n_words.append(w.counts())
                found = list(_hits(w, data, block, prefixes))
                if not sum(len(s) for s, _ in found):
                    continue
                start, window = (np.concatenate(x) for x in zip(*found, strict=True))
                new: dict[int, list[tuple[int, int]]] = {}
                first = w.first[w.row[start]]
                for row, a, b in zip(w.row[start].tolist(), (start - first).tolist(), (start - first + block.length[window]).tolist(), strict=True):
                    new.setdefault(row, []).append((a, b))
                for row, ranges in new.items():
                    hits[i + row] = merged([(h["start"], h["end"]) for h in hits[i + row]] + ranges)
                pairs = np.unique(np.column_stack([w.row[start], block.item[window]]), axis=0)
                for row, item in pairs.tolist():
                    if block.names[item] not in items[i + row]:
                        items[i + row].append(block.names[item])
            counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, HITS), pa.array(items, pa.list_(pa.string()))], batch.schema.names)

    return scan


def merged(ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Ranges that overlap or touch as one, in order."""
    out: list[dict[str, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1]["end"] >= a:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _n_blocks(items: DataFrame, block_bytes: int) -> int:
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-total // block_bytes))


def _block(items: DataFrame, k: int, n_blocks: int, seed: int) -> Block:
    mine = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
    return make_block([tuple(r) for r in mine.collect()], seed=seed)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_words, ``hits`` (ranges of words) and ``items``, a row per document."""
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    items = benchmark.select(benchmark[item_col].alias("item_id"), benchmark[item_text_col].alias("text")).where("text is not null")
    n_blocks, seed = _n_blocks(items, block_bytes), new_seed()
    out = docs.select("doc_id", "text", F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for k in range(n_blocks):
        block = _block(items, k, n_blocks, seed)
        out = out.mapInArrow(_scan(block, _prefixes(block, _frequencies(docs, block))), out.schema)
    return out.drop("text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` whose ``text`` has no window of any item, all columns as they are."""
    items = benchmark.select("item_id", "text").where("text is not null")
    n_blocks, seed = _n_blocks(items, block_bytes), new_seed()
    out = docs
    for k in range(n_blocks):
        block = _block(items, k, n_blocks, seed)
        out = out.mapInArrow(_clean(block, _prefixes(block, _frequencies(docs, block))), docs.schema)
    return out


def _clean(block: Block, prefixes: dict[int, Prefixes]):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for i, _, data, offsets in chunks(batch):
                w = _words(data, offsets, block.seed)
                for start, _ in _hits(w, data, block, prefixes):
                    keep[i + w.row[start]] = False
            yield batch.filter(pa.array(keep))

    return clean


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")).cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


#: The same by SQL: every window of the documents is joined with the windows of the items.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
