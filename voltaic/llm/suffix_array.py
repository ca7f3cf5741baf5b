"""Suffix-array deduplication of byte strings.

Every 50-byte string that also starts in a document with a smaller doc_id is removed. ``_repeats`` gathers the pieces of text
that may hold such strings, those with one anchor in one bin. There, pieces are packed into shards; a shard gets a suffix array by
Larsson-Sadakane refinement (prefix doubling that sorts only the groups still undecided) and common prefixes by Kasai's
algorithm; neighbours with 50 bytes in common are equal strings. Where the pieces of an anchor span shards, the sorted
strings of the shards before are searched by bisection.

Nulls are empty texts; null ids come before all others. Rows that share an id are one document: they do not remove from each other.
Texts under 50 bytes keep everything; long texts are taken whole. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import documents
from ._repeats import Finder, Pieces, Tokens, covered
from ._words import _INVERSE, _ROOT, _VALUES, powers

#: Bytes of a string, and of the grams whose least one anchors it.
WIDTH, GRAM = 50, 20
#: Bytes of a shard.
SHARD = 1 << 20


def byte_tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Each byte is a token."""
    n = len(data)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    at = np.arange(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * powers(_ROOT, n), out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * powers(_INVERSE, n + 1)[: max(0, n + 1 - GRAM)] if n >= GRAM else np.zeros(0, np.uint64)
    return Tokens(grams, np.repeat(offsets[1:], sizes) - at, row, at, at + 1)


def suffix_array(data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and their ranks. A suffix ends at ``end[i]``, where its piece does; equal ones are ordered by place."""
    n = len(data)
    at = np.arange(n)
    # The first seven bytes, and how many there are.
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    have = np.minimum(end - at, 7)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(8) | np.where(have > k, padded[k : k + n], np.uint64(0))
    key = key << np.uint64(8) | have.astype(np.uint64)
    order = np.argsort(key)
    known = key[order]
    new = np.append(True, known[1:] != known[:-1])
    # A rank is the place of the first of its group.
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    depth = 7
    sizes = np.diff(np.append(np.flatnonzero(new), n))
    todo = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in ``order`` of groups still undecided
    while len(todo):
        who = order[todo]
        after = who + depth
        # Equal suffixes that end within the depth are in order of place already.
        ended = after >= end[who]
        second = np.where(ended, who, n + rank[np.minimum(after, n - 1)])
        both = rank[who] * (2 * n) + second
        by = np.argsort(both)
        who, both = who[by], both[by]
        order[todo] = who
        new = np.append(True, both[1:] != both[:-1])
        rank[who] = todo[new][np.cumsum(new) - 1]
        sizes = np.diff(np.append(np.flatnonzero(new), len(who)))
        todo = todo[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return order, rank


def common_prefixes(data: np.ndarray, end: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, lanes: int = 2048) -> np.ndarray:
    """Kasai: for each suffix (by place), bytes in common with the one before it in order; over ``most`` counts as that.

    Lanes of text go forward together; a suffix has at least the prefix of the one a byte before it, less one.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = np.zeros(n + most + 8, np.uint64)
    padded = np.append(data, np.zeros(most + 16, np.uint8)).astype(np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : k + len(words)]
    room = np.where(before >= 0, np.minimum(end - np.arange(n), end[before] - before), 0)
    room = np.minimum(room, most)
    out = np.zeros(n, np.int64)
    lanes = max(1, min(lanes, n // 64))
    start = np.linspace(0, n, lanes + 1).astype(np.int64)
    stop, have = start[1:], np.zeros(lanes, np.int64)
    for step in range(int((stop - start[:-1]).max())):
        i = start[:-1] + step
        live = i < stop
        if not live.all():
            start, stop, have, i = np.append(start[:-1][live], 0), stop[live], have[live], i[live]
        j, limit = before[i], room[i]
        have = np.minimum(np.maximum(have - 1, 0), limit)
        more = np.flatnonzero(have < limit)
        while len(more):
            a, b, h = i[more], j[more], have[more]
            differ = words[a + h] ^ words[b + h]
            # Equal leading bytes of two big-endian words.
            same = np.where(differ == 0, 8, 7 - (np.frexp((differ >> np.uint64(11)).astype(np.float64))[1] + 10) // 8)
            same = np.where(differ < np.uint64(1 << 11), np.where(differ == 0, 8, np.where(differ < np.uint64(256), 7, 6)), same)
            have[more] = np.minimum(h + same, limit[more])
            more = more[(same == 8) & (have[more] < limit[more])]
        out[i] = have
    return out


def _strings(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(data, width)[at].copy().view(f"S{width}").reshape(-1)


def resolve(p: Pieces, width: int = WIDTH, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the strings that also start in a document of smaller order. Pieces come by anchor, then order."""
    ends = np.cumsum(p.size)
    out = []
    seen: tuple[np.ndarray, np.ndarray] | None = None  # sorted strings of the last anchor so far, and their least order
    i = 0
    while i < len(p.size):
        begin = int(ends[i] - p.size[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + shard, side="right")))
        data = p.bytes_of(i, j)
        size = p.size[i:j]
        piece = np.repeat(np.arange(i, j), size)
        end = np.repeat(ends[i:j] - begin, size)
        order, rank = suffix_array(data, end)
        prefix = common_prefixes(data, end, order, rank, width)
        starts = end - np.arange(len(data)) >= width
        mine = order[starts[order]]  # strings in order; a suffix too short for one has no string before or after in its class
        same = _chained(order, starts, prefix, width)
        number = np.cumsum(~same) - 1
        who = p.order[piece[mine]]
        least = np.minimum.reduceat(who, np.flatnonzero(~same))
        if seen is not None and p.anchor[i] == p.anchor[i - 1]:
            firsts = _strings(data, mine[~same], width)
            at = np.minimum(np.searchsorted(seen[0], firsts), len(seen[0]) - 1)
            least = np.where(seen[0][at] == firsts, np.minimum(least, seen[1][at]), least)
        goes = np.zeros(len(data), dtype=bool)
        goes[mine] = least[number] < who
        out.append(_ranges(goes, piece, data, p, begin, ends, width))
        if j < len(p.size) and p.anchor[j] == p.anchor[j - 1]:
            of = p.anchor[piece[mine]] == p.anchor[j - 1]
            strings = _strings(data, mine[of], width)
            known, at = np.unique(strings, return_index=True)
            orders = least[number][of][at]
            if seen is not None and p.anchor[i] == p.anchor[i - 1] == p.anchor[j - 1]:
                both, at = np.unique(np.concatenate([seen[0], known]), return_index=True)
                seen = both, np.concatenate([seen[1], orders])[at]
            else:
                seen = known, orders
        else:
            seen = None
        i = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _chained(order: np.ndarray, starts: np.ndarray, prefix: np.ndarray, width: int) -> np.ndarray:
    """For the strings in order: whether each equals the one before."""
    at = np.flatnonzero(starts[order])
    # Suffixes between two strings that are too short break the class, as they differ within the width.
    same = prefix[order[at]] >= width
    same[1:] &= np.diff(at) == 1
    if len(same):
        same[0] = False
    return same


def _ranges(goes: np.ndarray, piece: np.ndarray, data: np.ndarray, p: Pieces, begin: int, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that go, as ranges of their texts' bytes."""
    start = goes.copy()
    start[1:] &= ~goes[:-1] | (piece[1:] != piece[:-1])
    stop = goes.copy()
    stop[:-1] &= ~goes[1:] | (piece[1:] != piece[:-1])
    first, last = np.flatnonzero(start), np.flatnonzero(stop)
    of = piece[first]
    base = p.at[of] - (ends[of] - p.size[of] - begin)
    return p.address[of], base + first, base + last + width


FINDER = Finder(byte_tokens, GRAM, WIDTH, True, resolve)


def _finish(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple[int, int, int, str]:
    n = len(text)
    if not len(first):
        return n, 0, 0, hashlib.sha256(text).hexdigest()
    gone = covered(n, first, end)
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def _keep(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple[str]:
    return (np.frombuffer(text, np.uint8)[~covered(len(text), first, end)].tobytes().decode(errors="replace"),)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text that is left; a character cut by a removed byte is replaced."""
    return FINDER.removed(docs, id_col, text_col, _keep, "text string")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FINDER.removed(documents(spark, sf_dir), "doc_id", "text", _finish, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


#: The same by SQL: all 50-byte strings, as hexadecimal digits, are grouped by a hash of 128 bits.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, hex(b) AS h, octet_length(b)::BIGINT AS n FROM d),
-- A text in runs of 1,000 bytes, each with the 49 after it, so that no string is cut out of a long text.
c AS (SELECT doc_id, k * 1000 AS base, substr(h, k * 2000 + 1, 2098) AS s FROM (SELECT doc_id, h, unnest(range(0, n // 1000 + 1)) AS k FROM h)),
g AS (SELECT doc_id, base + i AS o, md5_number(substr(s, 2 * i + 1, 100)) AS m FROM (SELECT doc_id, base, s, unnest(range(0, least(1000, length(s) // 2 - 49))) AS i FROM c WHERE length(s) >= 100)),
r AS (SELECT doc_id, o FROM (SELECT doc_id, o, min(doc_id) OVER (PARTITION BY m) AS least_id FROM g) WHERE least_id < doc_id),
-- Runs of strings that go, as ranges of bytes.
e AS (SELECT doc_id, o, CASE WHEN o <= lag(o) OVER (PARTITION BY doc_id ORDER BY o) + 50 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(o) AS a, max(o) + 50 AS z FROM (SELECT doc_id, o, sum(new) OVER (PARTITION BY doc_id ORDER BY o) AS run FROM e) GROUP BY doc_id, run),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT p.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(z) AS last FROM p JOIN h USING (doc_id) GROUP BY p.doc_id)
SELECT h.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""
