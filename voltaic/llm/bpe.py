"""Byte-level BPE encoding with a hierarchical-bitmap rank queue, and decoding.

The bytes of a pre-token form a linked list. Each adjacent pair that merges into a token lies in the bucket of the
merged token's rank; a bitmap of two levels tells which buckets are filled, so the next rank is found by two
find-first-set steps, whatever the length of the pre-token. A merge removes its right part from the list and
adds the two new pairs; entries of pairs that no longer exist are stale and are skipped when their bucket comes up.
Within a bucket positions are merged from left to right, as the reference order asks. Where a batch has many new
pre-tokens, they share one queue, and all positions of a bucket are merged at once.

Nulls are empty texts; empty texts have no tokens. Repeated rows are rows of their own; texts are encoded whole.
An empty table gives an empty result. Columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import documents

#: Pre-tokens whose ids a Python worker remembers: of those seen once lately, and of those seen again. The older ones of a
#: kind go when it is full; it bounds memory only.
SEEN_ONCE, SEEN_AGAIN = 200_000, 400_000
#: Longer pre-tokens are not remembered.
CACHE_BYTES = 64
#: So many pre-tokens go through one queue together; below that each goes alone.
TOGETHER = 8_000
#: Characters of texts that are split before new pre-tokens are merged, and of pre-tokens merged together: both bound memory only.
GROUP, MERGED = 4_000_000, 2_000_000


#: Single bits of a word.
BITS = [1 << i for i in range(512)]


class RankQueue:
    """Buckets of positions by rank, under a bitmap of 512-bit words in two levels (up to 262,144 ranks)."""

    def __init__(self, ranks: int) -> None:
        assert ranks <= 1 << 18
        self.low, self.top = [0] * ((ranks >> 9) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 9] |= BITS[rank & 511]
        self.top |= BITS[rank >> 9]

    def first(self) -> int:
        """The lowest filled rank, -1 if there is none."""
        if not self.top:
            return -1
        i = (self.top & -self.top).bit_length() - 1
        word = self.low[i]
        return i << 9 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Empty the bucket of ``rank``."""
        word = rank >> 9
        self.low[word] ^= BITS[rank & 511]
        if not self.low[word]:
            self.top ^= BITS[word]
        return self.buckets.pop(rank)


class ByteBPE:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.sizes = [len(token) for token in self.tokens]
        self.bytes = [self.ranks.get(bytes([x])) for x in range(256)]
        self.pairs = [self.ranks.get(bytes([x, y])) for x in range(256) for y in range(256)]
        self.queue = RankQueue(len(self.tokens))
        self.keys: np.ndarray | None = None
        self.known: dict[str, bytes] = {}
        for token, rank in self.ranks.items():
            with suppress(UnicodeDecodeError):
                self.known[token.decode()] = rank.to_bytes(4, "little")
        self.group = GROUP >> 3
        self.once: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. The queue's push, first and take are written out here, since their calls would cost more than they do."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, rank_of, sizes, pairs, bits = len(piece), self.ranks.get, self.sizes, self.pairs, BITS
        low, buckets, top = self.queue.low, self.queue.buckets, 0
        ids = [self.bytes[x] for x in piece]
        end = list(range(1, n + 1))  # of the part that begins here; 0: none begins here
        before = list(range(-1, n - 1))
        left = piece[0] << 8
        for i in range(1, n):
            right = piece[i]
            rank = pairs[left | right]
            left = right << 8
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i - 1)
                else:
                    buckets[rank] = [i - 1]
                    word = rank >> 9
                    low[word] |= bits[rank & 511]
                    top |= bits[word]
        while top:
            word = (top & -top).bit_length() - 1
            filled = low[word]
            lowest = filled & -filled
            rank = word << 9 | lowest.bit_length() - 1
            low[word] = filled = filled ^ lowest
            if not filled:
                top ^= bits[word]
            bucket, size = buckets.pop(rank), sizes[rank]
            if len(bucket) > 1:
                bucket.sort()
            for k, i in enumerate(bucket):
                middle = end[i]
                # Stale: no part begins here, or it is the last one, or it is no longer of this pair.
                if not middle or middle >= n or end[middle] != i + size:
                    continue
                stop = i + size
                ids[i], end[i], end[middle], lower = rank, stop, 0, False
                if stop < n:
                    before[stop] = i
                    other = rank_of(piece[i : end[stop]])
                    if other is not None:
                        if other in buckets:
                            buckets[other].append(i)
                        else:
                            buckets[other] = [i]
                            word = other >> 9
                            low[word] |= bits[other & 511]
                            top |= bits[word]
                        lower = other < rank
                left = before[i]
                if left >= 0:
                    other = rank_of(piece[left:stop])
                    if other is not None:
                        if other in buckets:
                            buckets[other].append(left)
                        else:
                            buckets[other] = [left]
                            word = other >> 9
                            low[word] |= bits[other & 511]
                            top |= bits[word]
                        lower = lower or other < rank
                if lower and k + 1 < len(bucket):  # the new pair comes before the rest of this bucket
                    buckets.setdefault(rank, []).extend(bucket[k + 1 :])
                    word = rank >> 9
                    low[word] |= bits[rank & 511]
                    top |= bits[word]
                    break
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = end[i]
        return out

    def splits(self) -> None:
        """Ranks by pairs of ids, ``keys`` in order; none if some byte is no token."""
        found, size = {}, len(self.tokens)
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    found[left * size + right] = rank
        keys = np.array([] if None in self.bytes else sorted(found), np.int64)
        self.keys, self.merged = keys, np.array([found[k] for k in keys.tolist()], np.int64)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens as bytes. They go through one queue together, a bucket at once, which is the order of each of them alone as long as no merge makes a lower rank; those
        in which one does are merged again alone."""
        if len(pieces) >= TOGETHER and self.keys is None:
            self.splits()
        if len(pieces) < TOGETHER or not len(self.keys):
            return [struct.pack(f"<{len(ids)}I", *ids) for ids in map(self.merge, pieces)]
        queue, buckets, sizes, width = self.queue, self.queue.buckets, self.sizes, len(self.tokens)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, stops = len(data), np.cumsum([len(piece) for piece in pieces])
        # Parts by their first byte: id (-1: no part begins here), length, and the parts before and after; n is no part.
        ids = np.append(np.array(self.bytes, np.int32)[data], np.int32(-1))
        length = np.ones(n + 1, np.int32)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[stops - 1] = n
        before[np.append(0, stops[:-1])] = n
        rank = np.array([-1 if r is None else r for r in self.pairs], np.int32)[data[:-1].astype(np.int32) << 8 | data[1:]]
        rank[stops[:-1] - 1] = -1
        order = np.flatnonzero(rank >= 0).astype(np.int32)
        order = order[np.argsort(rank[order], kind="stable")]
        filled, start = np.unique(rank[order], return_index=True)
        given = dict(zip(filled.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(order)], strict=True), strict=True))
        for r in given:
            queue.push(r, n)
        lower = []
        while (r := queue.first()) >= 0:
            size, i = sizes[r], queue.take(r)
            if r in given:
                lo, hi = given.pop(r)
                i = order[lo:hi] if len(i) == 1 else np.unique(np.concatenate([order[lo:hi], np.array(i, np.int32)]))
            else:
                i = np.unique(np.array(i, np.int32))
            middle = after[i]
            # Stale: no part begins here, or it is the last one, or it is no longer of this pair.
            good = (ids[i] >= 0) & (middle < n) & (length[i] + length[middle] == size)
            i, middle = i[good], middle[good]
            if not len(i):
                continue
            shared = i[1:] == middle[:-1]
            if shared.any():  # from left to right: of pairs that share parts every second one
                k = np.arange(len(i))
                keep = (k - np.maximum.accumulate(np.where(np.append(False, shared), 0, k))) % 2 == 0
                i, middle = i[keep], middle[keep]
            stop = after[middle]
            ids[i], length[i], after[i] = r, size, stop
            ids[middle] = -1
            before[stop] = i
            left = before[i]
            first, second = i[stop < n], left[left < n]
            key = np.concatenate([r * width + ids[after[first]].astype(np.int64), ids[second].astype(np.int64) * width + r])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            for other, place in zip(self.merged[at[hit]].tolist(), np.concatenate([first, second])[hit].tolist(), strict=True):
                if other in buckets:
                    buckets[other].append(place)
                else:
                    queue.push(other, place)
                if other < r:
                    lower.append(place)
        alive = ids[:n] >= 0
        blob = ids[:n][alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive)[stops - 1] * 4).tolist()
        out = [blob[x:y] for x, y in zip([0, *ends], ends, strict=False)]
        for k in set(np.searchsorted(stops, lower, side="right").tolist()):
            one = self.merge(pieces[k])
            out[k] = struct.pack(f"<{len(one)}I", *one)
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; the pre-tokens of some texts that aren't remembered are merged together."""
        rows, wanted, n = [], {}, 0
        for text in texts:
            pieces = self.pattern.findall(text)
            parts = list(map(self.known.get, pieces))
            holes = [(i, pieces[i]) for i, ids in enumerate(parts) if ids is None]
            for _, piece in holes:
                wanted[piece] = piece in wanted
            rows.append((parts, holes))
            n += len(text)
            if n >= self.group:
                yield from self._filled(rows, wanted)
                rows, wanted, n = [], {}, 0
                # More is remembered by then.
                self.group = min(2 * self.group, GROUP)
        yield from self._filled(rows, wanted)

    def _filled(self, rows: list[tuple[list, list]], wanted: dict[str, bool]) -> Iterator[bytes]:
        """The rows with the ids of the ``wanted`` pre-tokens in their holes; those that occur again are True."""
        known, once, found = self.known, self.once, {}
        new, size = [], 0
        for k, piece in enumerate(wanted, 1):
            if piece in once:
                found[piece] = once.pop(piece)
                if len(known) >= SEEN_AGAIN:
                    known.clear()
                known[piece] = found[piece]
            else:
                new.append(piece)
                size += len(piece)
            if new and (size >= MERGED or k == len(wanted)):
                found.update(zip(new, self.merge_all([piece.encode() for piece in new]), strict=True))
                for x in new:
                    if len(x) <= CACHE_BYTES:
                        seen, most = (known, SEEN_AGAIN) if wanted[x] else (once, SEEN_ONCE)
                        if len(seen) >= most:
                            seen.clear()
                        seen[x] = found[x]
                new, size = [], 0
        for parts, holes in rows:
            for i, piece in holes:
                parts[i] = found[piece]
            yield b"".join(parts)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One per Python worker and file."""
    return ByteBPE(path, pattern)


def _mapped(docs: DataFrame, columns: list[str], schema: str, each: Callable[[list], Iterable[tuple]]) -> DataFrame:
    """``each`` makes the columns of ``schema`` from a batch of the second of ``columns``; the first is kept."""
    rows = docs.select(*(docs[c] for c in columns))
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(each(batch.column(1).to_pylist()))
            out = list(zip(*values, strict=True)) if values else [[] for _ in range(schema.count(",") + 1)]
            names = [c.split()[0] for c in schema.split(",")]
            kinds = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(",")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], [batch.schema.names[0], *names])

    return rows.mapInArrow(run, f"{rows.columns[0]} {id_type}, {schema}")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ``ids`` (binary: little-endian unsigned 32-bit integers), a row per document."""

    def each(texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
        for ids in tokenizer(path, pattern).encode_all(text or "" for text in texts):
            yield len(ids) // 4, ids

    return _mapped(docs, [id_col, text_col], "n_tokens bigint, ids binary", each)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the ``bytes`` that ``ids`` stand for; null ids give none."""
    return _mapped(encoded, [id_col, ids_col], "bytes binary", lambda rows: [(tokenizer(path, pattern).decode(ids or b""),) for ids in rows])


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, in one pass."""

    def each(texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        bpe = tokenizer(path, pattern)
        for ids in bpe.encode_all(text or "" for text in texts):
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _mapped(docs, [id_col, text_col], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", each)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
