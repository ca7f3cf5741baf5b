"""Where runs of tokens recur across a corpus, without sending every run through a shuffle.

A window is ``width`` tokens in a row. Its anchor is the least hash of the ``gram``-token runs in it, so equal windows
have equal anchors at equal places. Neighbouring windows mostly share an anchor; they make one piece of text.

1. Documents' anchors are sent to buckets, packed; a bucket finds the anchors that recur.
2. These go back to the documents, which cut the pieces of recurring anchors and send them to bins by anchor. Equal pieces of
   a batch are joined before that, so a passage with very many copies crosses the shuffle once per batch.
   The pieces of an anchor that very many documents have are cut into single windows, which go to bins by their content: where a hot
   passage begins and ends, each document has pieces of its own, and these must not all meet in one task.
3. A bin compares the pieces of each anchor, exactly, by the operator's own structure, and finds the windows to remove.
4. The ranges of those windows go to the documents.

The documents cross the shuffle once; steps 2 and 4 read the same exchange. Hashes only choose what is compared: anchors that are
equal by chance cost time, and pieces of equal content hashes are joined only after their bytes were compared, so no hash decides a result.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CHUNK, chunks
from ._words import _INVERSE, _ROOT, _VALUES, mix, powers

#: Bytes of text for each bin and each group of documents, about.
SHARE = 16 << 20
#: Entries that a task holds before it sends them on.
HELD = 1 << 20
#: Partitions at most, if the session asks for no more; a task takes its bins one after the other.
PARTITIONS = 20_000
#: Occurrences of an anchor that are too many for one bin: their strings would take over some 100 MB of a task. Windows taken apart cost
#: tens of times the bytes of a piece, so this is not done earlier; and windows that are packed at once.
HOT, WINDOWS = 1 << 17, 1 << 15
#: Of zstandard, for what is sent: text in pieces gets about a third smaller than by Spark's own compression.
LEVEL = 3
_KINDS = ["<u8", "<i8", "<u4", "<i4", "<u2", "u1"]
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of xxHash
_LOW48 = np.uint64((1 << 48) - 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed binary value."""
    head = [struct.pack("<B", len(arrays))]
    for a in arrays:
        head.append(struct.pack("<BI", _KINDS.index(a.dtype.str.replace("|", "")), len(a)))
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([*head, *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    (n,) = struct.unpack_from("<B", raw)
    at, out = 1 + 5 * n, []
    for i in range(n):
        kind, size = struct.unpack_from("<BI", raw, 1 + 5 * i)
        out.append(np.frombuffer(raw, _KINDS[kind], size, at))
        at += out[-1].nbytes
    return out


def bins_for(df: DataFrame, size: int) -> int:
    """How many bins, for a corpus of so many bytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))


def partitions_for(df: DataFrame, n: int) -> int:
    """Over how many partitions n keys are dealt, within reason: more than ``PARTITIONS`` where the session's own setting is higher."""
    return min(n, max(PARTITIONS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """Rows of each of n keys together and keys in order, over as many partitions as there are keys, within reason."""
    return df.repartition(partitions_for(df, n), key).sortWithinPartitions(key)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows without it) of rows that come in order of the key, their first column."""
    key, rows = None, []
    for batch in batches:
        for k, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append(tuple(rest))
    if rows:
        yield key, rows


def xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of one bigint column."""

    def turn(v: np.ndarray, by: int) -> np.ndarray:
        return v << np.uint64(by) | v >> np.uint64(64 - by)

    h = np.uint64(42 + 8) + _P5 ^ turn(x.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return (h ^ h >> np.uint64(32)).view(np.int64)


@dataclass
class Tokens:
    """Tokens of some texts: hashes of the grams from each, tokens left in its text, the text, and byte bounds."""

    grams: np.ndarray
    left: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


@dataclass
class Runs:
    """Runs of windows that share an anchor: first and last window (as tokens), the anchor, and whether it occurs twice in the run."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    twice: np.ndarray


def least(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` grams in a row."""
    out, have = grams, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(t: Tokens, gram: int, width: int, twice: bool) -> Runs:
    """All windows of ``width`` tokens, as runs; ``twice``: see which anchors occur twice in their run."""
    span = width - gram + 1
    n = len(t.left) - width + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return Runs(empty, empty, np.zeros(0, np.uint64), np.zeros(0, bool))
    anchor = least(t.grams, span)[:n]
    whole = t.left[:n] >= width
    turn = np.empty(n, dtype=bool)
    turn[0] = True
    turn[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    first = np.flatnonzero(turn & whole)
    stop = np.ones(n, dtype=bool)
    stop[:-1] = turn[1:] | ~whole[1:]
    last = np.flatnonzero(stop & whole)
    value = anchor[first]
    if not twice:
        return Runs(first, last, value, np.zeros(len(first), bool))
    grams = _spread(first, last + span - 1)
    n_grams = last - first + span
    owner = np.repeat(np.arange(len(first)), n_grams)[t.grams[grams] == np.repeat(value, n_grams)]
    return Runs(first, last, value, np.bincount(owner, minlength=len(first)) > 1)


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0]..last[0], first[1]..last[1], ..."""
    n = last - first + 1
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


@dataclass
class Pieces:
    """Pieces of a bin: the texts' addresses and order, each piece's first token in its text, its tokens, anchor, content and bytes."""

    address: np.ndarray
    order: np.ndarray
    at: np.ndarray
    tokens: np.ndarray
    twice: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    start: np.ndarray
    size: np.ndarray
    data: np.ndarray

    def bytes_of(self, i: int, j: int) -> np.ndarray:
        """The bytes of pieces i to j - 1, one after the other."""
        return self.data[_spread(self.start[i:j], self.start[i:j] + self.size[i:j] - 1)]


def _content_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * powers(_ROOT, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))


def _content_hashes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of pieces that lie one after the other, a megabyte at a time."""
    end = np.cumsum(size)
    out, i = [np.zeros(0, np.uint64)], 0
    while i < len(size):
        base = int(end[i] - size[i])
        j = max(i + 1, int(np.searchsorted(end, base + (1 << 20), side="right")))
        out.append(_content_hash(data[base : int(end[j - 1])], end[i:j] - size[i:j] - base, end[i:j] - base))
        i = j
    return np.concatenate(out)


@dataclass
class Finder:
    """``tokens``: from bytes and offsets; ``resolve``: from the pieces of a bin to (address, first token, token after the last) of what goes.

    ``across``: an anchor must recur in another document; else anywhere else.
    """

    tokens: Callable[[np.ndarray, np.ndarray], Tokens]
    gram: int
    width: int
    across: bool
    resolve: Callable[[Pieces], tuple[np.ndarray, np.ndarray, np.ndarray]]
    hot: int = HOT

    def removed(self, docs: DataFrame, id_col: str, text_col: str, finish: Callable, schema: str) -> DataFrame:
        """``finish(text, ranges)`` for each document, ranges being (first token, token after the last) in order; ``schema``: its columns."""
        docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
        each = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
        facts = each.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
        n = bins_for(docs, facts["size"])
        # Ids are addresses; where rows share one or it is null, a hash of the row is.
        own = facts["n"] <= 1 and not facts["nulls"]
        order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
        rows = docs.select(F.lit(None).cast("int").alias("group"), "doc_id", order.alias("order"), (order if own else F.xxhash64("doc_id", "text")).alias("address"), "text")
        groups = 2 * n
        rows = rows.withColumn("group", F.pmod(F.xxhash64("address"), F.lit(groups)).cast("int"))
        found = self._recurring(rows, n, groups)
        pieces = rows.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(self._cut(n), "bin int, kind int, data binary")
        ranges = dealt(pieces, n, "bin").mapInArrow(self._resolve(groups), "group int, data binary")
        kind = docs.schema["doc_id"].dataType.simpleString()
        return rows.groupBy("group").cogroup(ranges.groupBy("group")).applyInArrow(_finished(finish, schema), f"doc_id {kind}, {schema}")

    def _recurring(self, rows: DataFrame, n: int, groups: int) -> DataFrame:
        """Step 1: (group, packed marks of address and anchor, packed hot anchors) for the anchors that recur."""
        tokens, gram, width, across, hot = self.tokens, self.gram, self.width, self.across, self.hot

        def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0
            for batch in batches:
                address, order = (batch.column(i).to_numpy() for i in (0, 1))
                for i, _, data, offsets in chunks(batch, "text", CHUNK // 2):
                    t = tokens(data, offsets)
                    r = runs(t, gram, width, not across)
                    row = t.row[r.first] + i
                    value = r.anchor & _LOW48
                    if across:  # once for each document
                        first = np.unique(np.column_stack([row.astype(np.uint64), value]), axis=0, return_index=True)[1] if len(row) else row
                        row, value = row[first], value[first]
                    else:  # twice where windows of one run may be equal
                        row, value = np.concatenate([row, row[r.twice]]), np.concatenate([value, value[r.twice]])
                    held.append((address[row], order[row], value))
                    size += len(row)
                    if size >= HELD:
                        yield _buckets(held, n)
                        held, size = [], 0
            if size:
                yield _buckets(held, n)

        def recur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, parts in by_key(batches):
                columns = [unpack(raw) for (raw,) in parts]
                value = np.concatenate([c[3].astype(np.uint64) << np.uint64(32) | c[4].astype(np.uint64) for c in columns])
                address = np.concatenate([np.repeat(c[0], c[2]) for c in columns])
                owner = address + np.concatenate([np.repeat(c[1], c[2]) for c in columns]) if across else address
                by = np.argsort(value, kind="stable")
                value, address, owner = value[by], address[by], owner[by]
                same = value[1:] == value[:-1]
                often = np.bincount(np.concatenate([[0], np.cumsum(~same)]))
                often = np.repeat(often, often) > hot
                if across:
                    # A group of one value recurs if its owners differ: mark groups with a change of owner inside.
                    group = np.concatenate([[0], np.cumsum(~same)])
                    differs = np.zeros(group[-1] + 1, dtype=bool)
                    differs[group[1:][same & (owner[1:] != owner[:-1])]] = True
                    keep = differs[group]
                else:
                    keep = np.zeros(len(value), dtype=bool)
                    keep[1:] |= same
                    keep[:-1] |= same
                address, value, often = address[keep], value[keep], often[keep]
                group = np.mod(xxhash64(address), groups).astype(np.uint64)
                mark, many = (np.unique(np.column_stack(x), axis=0) for x in ((group, _mark(address, value)), (group[often], value[often])))
                names, first = np.unique(mark[:, 0], return_index=True)
                low, high = (np.searchsorted(many[:, 0], names, side=x) for x in ("left", "right"))
                for g, part, a, b in zip(names.tolist(), np.split(mark[:, 1], first[1:]), low.tolist(), high.tolist(), strict=False):
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([pack(part, many[a:b, 1])], pa.binary())], ["group", "data"])

        sent = rows.select("address", "order", "text").mapInArrow(anchors, "bucket int, data binary")
        return dealt(sent, n, "bucket").mapInArrow(recur, "group int, data binary")

    def _cut(self, n: int):
        """Step 2: pieces of recurring anchors, by bin. kind 0: packed pieces, 1: ranges already known to go."""
        tokens, gram, width, across = self.tokens, self.gram, self.width, self.across

        def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
            out: list[dict] = []
            both = [unpack(x) for x in found.column("data").to_pylist()]
            marks, hot = (np.sort(np.concatenate([x[i] for x in both])) if both else np.zeros(0, np.uint64) for i in (0, 1))
            for batch in docs.to_batches() if len(marks) else []:
                address, order = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("address", "order"))
                for i, _, data, offsets in chunks(batch, "text", CHUNK // 2):
                    t = tokens(data, offsets)
                    r = runs(t, gram, width, not across)
                    row = t.row[r.first] + i
                    mark = _mark(address[row], r.anchor & _LOW48)
                    at = np.minimum(np.searchsorted(marks, mark), len(marks) - 1)
                    keep = np.flatnonzero(marks[at] == mark)
                    if not len(keep):
                        continue

                    def pieces(first: np.ndarray, last: np.ndarray, row: np.ndarray, twice: np.ndarray, anchor: np.ndarray | None) -> Pieces:
                        start, end = t.start[first], t.end[last]
                        content = _content_hash(data, start, end)
                        return Pieces(
                            address[row], order[row], first - np.searchsorted(t.row, row - i), last - first + 1, twice,
                            content if anchor is None else anchor, content, start, end - start, data,
                        )

                    often = np.isin(r.anchor[keep] & _LOW48, hot)
                    out += _bins(pieces(*(x[keep[~often]] for x in (r.first, r.last + width - 1)), row[keep[~often]], r.twice[keep[~often]], r.anchor[keep[~often]]), n, across)
                    keep = keep[often]
                    if not len(keep):
                        continue
                    # Pieces that are equal to others of this batch, as far as these tell their fate; then windows of the rest.
                    p = pieces(r.first[keep], r.last[keep] + width - 1, row[keep], r.twice[keep], r.anchor[keep])
                    goes = _fated(p, across)
                    out += _gone(p, goes, n)
                    keep = keep[~goes]
                    window = _spread(r.first[keep], r.last[keep])
                    of = np.repeat(keep, r.last[keep] - r.first[keep] + 1)
                    for k in range(0, len(window), WINDOWS):
                        w, o = window[k : k + WINDOWS], of[k : k + WINDOWS]
                        out += _bins(pieces(w, w + width - 1, row[o], np.zeros(len(o), bool), None), n, across)
            return pa.Table.from_pylist(out, pa.schema([("bin", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())]))

        return cut

    def _resolve(self, groups: int):
        """Step 3: bins to ranges."""
        resolve, across = self.resolve, self.across

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, parts in by_key(batches):
                for kind, raw in parts:
                    if kind:
                        yield _by_group(*unpack(raw), groups)
                columns = [unpack(raw) for kind, raw in parts if not kind]
                if not columns:
                    continue
                address, order, at, size, twice, anchor, tokens, data = (np.concatenate(c) for c in zip(*columns, strict=True))
                del columns, parts
                size = size.astype(np.int64)
                end = np.cumsum(size)
                p = Pieces(address, address + order, at.astype(np.int64), tokens.astype(np.int64), twice, anchor, _content_hashes(data, size), end - size, size, data)
                p, gone = join_equal(p, across)
                yield _by_group(*gone, groups)
                # An anchor with one piece has nothing to compare, unless it occurs twice in it.
                few = _distinct(p, across)
                if len(few.anchor):
                    yield _by_group(*resolve(few), groups)

        return run


def _mark(address: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(address.astype(np.int64).view(np.uint64) ^ mix(value))


def _buckets(held: list, n: int) -> pa.RecordBatch:
    """Rows (bucket, packed): addresses, order less address, entries of each, and the values' high and low parts."""
    address, order, value = (np.concatenate(x) for x in zip(*held, strict=True))
    bucket = (value % np.uint64(n)).astype(np.int64)
    by = np.lexsort((address, bucket))
    address, order, value, bucket = address[by], order[by], value[by], bucket[by]
    rows = []
    for part in np.split(np.arange(len(by)), np.flatnonzero(np.diff(bucket)) + 1):
        a, v = address[part], value[part]
        new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        count = np.diff(np.append(new, len(a)))
        rows.append((int(bucket[part[0]]), pack(a[new], order[part][new] - a[new], count.astype("<u4"), (v >> np.uint64(32)).astype("<u2"), v.astype("<u4"))))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])


def _heads(p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Pieces in order of content, then of their texts; and the group of equal content of each.

    Content hashes sort the pieces; the bytes of each are then compared with those of the first of its group, and a piece that differs
    (its hash is equal by chance or by design) gets a group of its own.
    """
    by = np.lexsort((p.address, p.order, p.content, p.anchor))
    n = len(by)
    if not n:
        return by, by
    new = np.append(True, (p.content[by][1:] != p.content[by][:-1]) | (p.anchor[by][1:] != p.anchor[by][:-1]))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    for begin, end in _slices(p.size[by], CHUNK):
        mine = np.flatnonzero(head[begin:end] != np.arange(begin, end)) + begin
        other = by[head[mine]]
        alone = p.size[by[mine]] != p.size[other]
        rest, first = by[mine][~alone], other[~alone]
        size = p.size[rest]
        if size.sum():
            same = p.data[_spread(p.start[rest], p.start[rest] + size - 1)] == p.data[_spread(p.start[first], p.start[first] + size - 1)]
            alone[~alone] = ~np.logical_and.reduceat(same, np.cumsum(size) - size)
        new[mine[alone]] = True
    # A piece that stands alone comes after all others of its hash, so that these stay one group.
    odd = new & (head != np.arange(n))
    if odd.any():
        rank = np.lexsort((np.arange(n), odd, head))
        by, new = by[rank], new[rank]
    return by, np.cumsum(new) - 1


def _slices(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Rows in runs of about ``limit`` bytes."""
    end, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(end, end[i] - size[i] + limit, side="right")))
        yield i, j
        i = j


def join_equal(p: Pieces, across: bool) -> tuple[Pieces, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces without those whose fate is known from an equal piece, and the ranges of those that go.

    across: of equal pieces all but those of the first document go. Else: all go, and one stays to be compared with others.
    """
    if not len(p.anchor):
        return p, (p.address, p.at, p.at)
    by, group = _heads(p)
    first = np.append(True, group[1:] != group[:-1])
    head = by[first][group]
    if across:
        goes = p.order[by] > p.order[head]
        stays = ~goes
    else:
        goes = np.bincount(group)[group] > 1
        stays = first
    gone = by[goes]
    return _take(p, np.sort(by[stays])), (p.address[gone], p.at[gone], p.at[gone] + p.tokens[gone])


def _distinct(p: Pieces, across: bool) -> Pieces:
    """The pieces whose anchor has others of different content (or that may repeat in themselves), by anchor and then order."""
    by, group = _heads(p)
    anchor = p.anchor[by]
    new_anchor = np.append(True, anchor[1:] != anchor[:-1]) if len(by) else np.zeros(0, bool)
    number = np.cumsum(new_anchor) - 1
    first = np.append(True, group[1:] != group[:-1]) if len(by) else np.zeros(0, bool)
    contents = np.bincount(number, weights=first)[number] if len(by) else first
    keep = contents > 1
    if not across:
        keep |= p.twice[by].astype(bool)
    keep = by[keep]
    return _take(p, keep[np.lexsort((p.address[keep], p.order[keep], p.anchor[keep]))])


def _take(p: Pieces, at: np.ndarray) -> Pieces:
    return Pieces(*(getattr(p, c)[at] for c in ("address", "order", "at", "tokens", "twice", "anchor", "content", "start", "size")), p.data)


def _fated(p: Pieces, across: bool) -> np.ndarray:
    """Which pieces go for sure, by equal ones that stay."""
    by, group = _heads(p)
    first = np.append(True, group[1:] != group[:-1])[: len(by)]
    goes = np.zeros(len(by), dtype=bool)
    if across:
        goes[by] = p.order[by] > p.order[by[first][group]]
    else:
        # The first two of equal pieces tell the bin that all of them go.
        goes[by] = np.arange(len(by)) - np.flatnonzero(first)[group] > 1
    return goes


def _gone(p: Pieces, goes: np.ndarray, n: int) -> list[dict]:
    """Ranges already known to go, as a row for any bin."""
    if not goes.any():
        return []
    bin_ = int((p.anchor[goes][0] >> np.uint64(32)) % np.uint64(n))
    return [{"bin": bin_, "kind": 1, "data": pack(p.address[goes], p.at[goes], p.at[goes] + p.tokens[goes])}]


def _bins(p: Pieces, n: int, across: bool) -> list[dict]:
    """Packed pieces by bin; equal ones of this batch are joined where their fate is known."""
    goes = _fated(p, across)
    out = _gone(p, goes, n)
    number = (p.anchor >> np.uint64(32)) % np.uint64(n)
    stay = np.flatnonzero(~goes)
    stay = stay[np.argsort(number[stay], kind="stable")]
    for part in np.split(stay, np.flatnonzero(np.diff(number[stay].astype(np.int64))) + 1) if len(stay) else []:
        raw = p.data[_spread(p.start[part], p.start[part] + p.size[part] - 1)]
        # 32 bits of the anchor will do to tell those of a bin apart; if two were taken for one, more would be compared.
        out.append({"bin": int(number[part[0]]), "kind": 0, "data": pack(p.address[part], p.order[part] - p.address[part], p.at[part].astype("<u4"), p.size[part].astype("<u4"), p.twice[part].astype("u1"), p.anchor[part].astype("<u4"), p.tokens[part].astype("<u4"), raw)})
    return out


def _by_group(address: np.ndarray, first: np.ndarray, end: np.ndarray, groups: int) -> pa.RecordBatch:
    """Rows (group, packed ranges)."""
    group = np.mod(xxhash64(address), groups)
    by = np.argsort(group, kind="stable")
    rows = [(int(group[part[0]]), pack(address[part], first[part].astype(np.int64), end[part].astype(np.int64))) for part in np.split(by, np.flatnonzero(np.diff(group[by])) + 1) if len(part)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["group", "data"])


def _finished(finish: Callable, schema: str):
    """Step 4: each document with its ranges."""
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [{"bigint": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(",")]

    def run(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        address, first, end = (np.concatenate(x) for x in zip(*map(unpack, ranges.column("data").to_pylist()), strict=True)) if ranges.num_rows else (empty,) * 3
        by = np.lexsort((first, address))
        address, first, end = address[by], first[by], end[by]
        mine = docs.column("address").to_numpy()
        low, high = np.searchsorted(address, mine), np.searchsorted(address, mine, side="right")
        rows = [finish((text or "").encode(), first[a:b], end[a:b]) for text, a, b in zip(docs.column("text").to_pylist(), low.tolist(), high.tolist(), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.Table.from_arrays([docs.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return run


def covered(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n tokens lie in any of the ranges."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, np.minimum(first, n), 1)
    np.add.at(edges, np.minimum(end, n), -1)
    return np.cumsum(edges)[:-1] > 0
