"""Jaccard join of shingle sets by PartEnum signatures, as classes of linked documents.

A document's set has its distinct shingles of ``k`` words (64-bit hashes). Sizes are cut into bands so that sets similar enough lie
in one band or in neighbouring ones; a set takes part in its own band's instance and in the next. In an instance two
linked sets differ in d shingles at most. The shingles' domain is cut into n1 parts, so one part has d // n1 differences at most,
and each part into n2, of which all but d // n1 have none: every subset of that many is a signature, and linked sets share one.
Signatures of few shingles, which unrelated sets share by chance, are left out as far as a set's size leaves it parts to spare.

1. Equal sets are one class, whatever their number, and classes are the nodes. Their signatures go to buckets, packed; those of two
   classes or more are groups, and groups with the same members are one.
2. Each member is compared with that first member of its groups with which it shares most, and linked ones get one label (components by least
   label and pointer jumping, each round written to the shared folder). So a group of near copies costs a row per member.
3. What stays in groups of several labels, mostly sets that share a passage, is compared inside tasks, block by block, by parity
   sketches that are as long as the sets are: a bit per hash value says whether an odd number of shingles has it, so sketches
   differ in no more bits than sets in shingles, and pairs further apart than linked ones can be never become rows. Of the near
   pairs a task sends on only those that a spanning forest needs: first within blocks, then across them. What these leave
   undecided (near pairs that turned out not to be linked, between labels) is sent on whole at last.

Sketches only leave pairs out that can't be linked; every link is verified on the texts. Hashes are keyed by a number drawn for each
query, so different shingles are taken for one by 64-bit chance only.

Nulls, empty texts and texts without words have empty sets and are linked with nothing. Texts of fewer than k words are one
shingle. Repeated rows are copies; rows that share an id may differ in text and link as different documents do; rows with a null id
are linked but never name a component (theirs is null if all are). An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import CHUNK, chunks, documents, drop, let_go, stage, stage_by
from ._repeats import HELD, _buckets, bins_for, by_key, dealt, partitions_for, unpack
from ._words import _MUL, NOT_WHITE, mix, new_seed, shingle_hashes, split_words

_LOW48 = np.uint64((1 << 48) - 1)
_SIGN = np.uint64((1 << 63) - 1)
#: Words of 64 bits that the shortest parity sketch has, members of a block of a group, and pairs that are compared at once.
LEAST, PAIR_BLOCK, PAIRS = 2, 2048, 1 << 16
#: Bytes of text whose sets are made at once: arrays of words and shingles take some forty times as much.
SETS = CHUNK // 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, in order."""
    w = split_words(data, offsets, NOT_WHITE, lower=True, seed=seed)
    n = w.counts()
    hashes, rows = [], []
    whole = np.flatnonzero(w.left() >= k)
    hashes.append(shingle_hashes(w.hash, k)[whole] if len(whole) else np.zeros(0, np.uint64))
    rows.append(w.row[whole])
    for size in range(1, k):
        few = np.flatnonzero(n == size)
        if len(few):
            hashes.append(shingle_hashes(w.hash, size)[w.first[few]])
            rows.append(few)
    row, value = np.concatenate(rows), np.concatenate(hashes)
    by = np.lexsort((value, row))
    row, value = row[by], value[by]
    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])) if len(row) else np.zeros(0, bool)
    return row[new], value[new]


def set_classes(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each of n sets, and a hash of the whole set (0: empty)."""
    size = np.bincount(row, minlength=n)
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value + _MUL), out=sums[1:])
    end = np.cumsum(size)
    out = mix((sums[end] - sums[end - size]) + size.astype(np.uint64)) & _SIGN
    return size, np.where(size > 0, np.maximum(out, np.uint64(1)), np.uint64(0)).astype(np.int64)


def _unseen(name: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes with 0 for those that are in ``seen`` (in order) or occur earlier, and ``seen`` with the rest: eight bytes for each set of a task."""
    first = np.unique(name, return_index=True)[1]
    fresh = first[~np.isin(name[first], seen, assume_unique=True)]
    out = np.zeros_like(name)
    out[fresh] = name[fresh]
    return out, np.union1d(seen, name[fresh])


@lru_cache(maxsize=32)
def bands(percent: int, largest: int, level: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """First sizes of the bands up to ``largest`` and beyond, and (differences, n1, n2) of each band's instance.

    A part has ``level`` differences at most (all there are in small sets, so that their signatures have several shingles too).
    """
    first, plan, low = [], [], 1
    while not first or first[-1] <= largest:
        high = low * 100 // percent
        first.append(low)
        d = (2 * high * (100 - percent)) // (100 + percent)
        n1 = 1 if d <= level + 2 else -(-(d + 1) // (level + 1))
        plan.append((d, n1, d // n1 + (2 if d // n1 == 1 else 3 if d // n1 == 2 else 4)))
        low = high + 1
    return np.array(first), plan


def _spare(size: np.ndarray, band: np.ndarray, step: int, first: np.ndarray, percent: int, n1: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many parts of each set may go without signatures that share too little: one less than the parts with ``least`` differences at most.

    Linked sets a, b differ in (a + b)(100 - p)/(100 + p) shingles at most. In the next band's instance (``step`` 1) a set meets all that it may
    be linked with, its own band's sets too; so in its own band's it is there for smaller bands' sets alone.
    """
    partner = size * 100 // percent if step else first[band] - 1
    return np.maximum(n1 - 1 - (size + partner) * (100 - percent) // (100 + percent) // (least + 1), 0)


def signatures(row: np.ndarray, value: np.ndarray, size: np.ndarray, percent: int, level: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of every set that may be linked with another one.

    Cells of a signature may have few shingles or none, which sets share by chance; groups of these would grow with the corpus, and their pairs with
    its square. A set leaves out what has fewer shingles than ``floor``, the most that leaves it a part more than it can spare: linked sets
    have more parts in common than the one of higher floor spares, so they share a signature that has as many, which the other one sends too.
    """
    if not len(row):
        return row, value
    first, plan = bands(percent, int(size.max()) * 2 + 100, level)
    band = np.searchsorted(first, np.maximum(size, 1), side="right") - 1
    rows, out = [], []
    for step in (0, 1):
        instance = band + step
        d, n1, n2 = (np.array([plan[i][c] for i in instance]) for c in range(3))
        used = (size > 0) & (d > 0)
        cells = np.where(used, n1 * n2, 0)
        base = np.cumsum(cells) - cells
        mine = used[row]
        r, v = row[mine], value[mine]
        # Cells are ranges of hashes, so the sorted shingles are sorted by cell.
        cell = base[r] + (((v >> np.uint64(32)) * cells[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(cell, minlength=int(cells.sum()))
        end = np.cumsum(count)
        local = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(mix(v), out=local[1:])
        each = mix(local[end] - local[end - count] + count.astype(np.uint64))
        owner = np.repeat(np.arange(len(size)), cells)
        place = np.arange(len(owner)) - base[owner]
        spare = _spare(size, band, step, first, percent, n1, d // np.maximum(n1, 1))
        for kind in {(int(a), int(b)) for a, b in zip((d // np.maximum(n1, 1))[used], n2[used], strict=True)}:
            least, parts = kind
            of = np.flatnonzero(used & (d // np.maximum(n1, 1) == least) & (n2 == parts))
            grid_at = np.flatnonzero(np.isin(owner, of))
            grid, held = each[grid_at].reshape(-1, parts), count[grid_at].reshape(-1, parts)
            who, part = owner[grid_at][::parts], place[grid_at][::parts] // parts
            tag = mix(instance[who].astype(np.uint64) << np.uint64(32) | part.astype(np.uint64))
            # The poorest signature of each part, those of a set in order.
            poorest = np.sort(held, axis=1)[:, : parts - least].sum(axis=1)
            poorest = poorest[np.lexsort((poorest, who))]
            floor = np.zeros(len(size), np.int64)
            floor[of] = poorest[np.searchsorted(who, of) + spare[of]]
            floor = floor[who]
            for k, chosen in enumerate(combinations(range(parts), parts - least)):
                keep = np.flatnonzero(held[:, list(chosen)].sum(axis=1) >= floor)
                sig = tag[keep] + np.uint64(k)
                for c in chosen:
                    sig = mix(sig * _MUL + grid[keep, c])
                rows.append(who[keep])
                out.append(sig)
    return (np.concatenate(rows), np.concatenate(out)) if rows else (row[:0], value[:0])


def sketches_of(row: np.ndarray, value: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parities of each set, over a power of two of bits, two or more for each shingle."""
    words = LEAST << np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) * 2 / (64 * LEAST)))).astype(np.int64)
    base = np.cumsum(words) - words
    at = base[row] * 64 + (mix(value + np.uint64(7)) % (words[row] * 64).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(words.sum()) * 64) & 1).astype(bool))
    return [packed[a : a + n].tobytes() for a, n in zip((base * 8).tolist(), (words * 8).tolist(), strict=True)]


def _classes(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """doc_id, size of its set, class (0: empty) and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, sketches = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for i, j, data, offsets in chunks(batch, limit=SETS):
                row, value = shingle_sets(data, offsets, k, seed)
                size, cls = set_classes(row, value, j - i)
                sizes.append(size)
                classes.append(cls)
                sketches += sketches_of(row, value, size)
            columns = [batch.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(classes)), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "sketch"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, class bigint, sketch binary")


def with_class(docs: DataFrame, text_col: str, k: int, seed: int) -> DataFrame:
    """``docs`` with the class of each row's set as ``_class``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = [np.zeros(0, np.int64)]
            for i, j, data, offsets in chunks(batch, text_col, SETS):
                classes.append(set_classes(*shingle_sets(data, offsets, k, seed), j - i)[1])
            yield batch.append_column("_class", pa.array(np.concatenate(classes)))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_class", LongType())]))


def _groups(docs: DataFrame, k: int, percent: int, n: int, level: int, seed: int) -> DataFrame:
    """(group, node, weight): distinct sets of classes that share a signature, and how many signatures these share."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for i, j, data, offsets in chunks(batch, limit=SETS):
                row, value = shingle_sets(data, offsets, k, seed)
                size, name = set_classes(row, value, j - i)
                # Copies in a task sign once.
                name, seen = _unseen(name, seen)
                mine = name[row] != 0
                who, sig = signatures(row[mine], value[mine], np.where(name != 0, size, 0), percent, level)
                for begin in range(0, len(who), HELD):
                    part = slice(begin, begin + HELD)
                    held.append((name[who[part]], name[who[part]], sig[part] & _LOW48))
                    count += len(who[part])
                    if count >= HELD:
                        yield _buckets(held, n)
                        held, count = [], 0
        if count:
            yield _buckets(held, n)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in by_key(batches):
            columns = [unpack(raw) for (raw,) in parts]
            sig = np.concatenate([c[3].astype(np.uint64) << np.uint64(32) | c[4].astype(np.uint64) for c in columns])
            cls = np.concatenate([np.repeat(c[0], c[2]) for c in columns])
            del columns, parts
            # Most signatures are alone: leave them before sorting by class too.
            by = np.argsort(sig)
            sig, cls = sig[by], cls[by]
            same = sig[1:] == sig[:-1]
            keep = np.append(False, same) | np.append(same, False)
            sig, cls = sig[keep], cls[keep]
            by = np.lexsort((cls, sig))
            sig, cls = sig[by], cls[by]
            new = np.append(True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1]))[: len(sig)]
            sig, cls = sig[new], cls[new]
            if not len(sig):
                continue
            begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            count = np.diff(np.append(begin, len(sig)))
            group = mix(np.add.reduceat(mix(cls.view(np.uint64)), begin)) & _SIGN
            _, at, times = np.unique(group, return_index=True, return_counts=True)
            weight = np.zeros(len(group), np.int64)
            weight[at] = times
            keep = np.repeat((weight > 0) & (count > 1), count)
            if keep.any():
                columns = [np.repeat(group, count)[keep].astype(np.int64), cls[keep], np.repeat(weight, count)[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["group", "node", "weight"])

    sent = docs.select("text").mapInArrow(sign, "bucket int, data binary")
    found = dealt(sent, n, "bucket").mapInArrow(gather, "group bigint, node bigint, weight bigint")
    return found.groupBy("group", "node").agg(F.sum("weight").alias("weight"))


def _both(edges: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """Edges (a, b) with columns of both ends. A node with very many edges is split by Spark's own skew join.

    Edges and nodes grow with the corpus, so neither is broadcast at any size.
    """
    for end in ("b", "a"):
        edges = edges.join(of.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)).hint("merge"), end)
    return edges


def _near(edges: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of the edges whose sketches are near enough for a link."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes = np.concatenate([batch.column(c).to_numpy() for c in ("size_a", "size_b")])
            s = Sketches(sizes, [*batch.column("sketch_a").to_pylist(), *batch.column("sketch_b").to_pylist()])
            found = s.near(np.arange(n), np.arange(n) + n, percent)[0]
            yield batch.select(["a", "b"]).take(pa.array(found))

    return _both(edges, sketches, "size", "sketch").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(near, "a bigint, b bigint")


def _linked(edges: DataFrame, texts: DataFrame, k: int, percent: int, seed: int) -> DataFrame:
    """Those of the edges (a, b) whose texts' sets are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good: list[np.ndarray] = []
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                sets = []
                for column in ("text_a", "text_b"):
                    own: list[np.ndarray] = []
                    # One hub has many edges in a row; its set is made once a part.
                    codes = part.column(part.schema.get_field_index(column)).dictionary_encode()
                    distinct = pa.RecordBatch.from_arrays([codes.dictionary], ["text"])
                    for i, j, data, offsets in chunks(distinct, limit=SETS):
                        row, value = shingle_sets(data, offsets, k, seed)
                        own += np.split(value, np.searchsorted(row, np.arange(1, j - i)))
                    sets.append([own[c] for c in codes.indices.to_pylist()])
                ok = np.zeros(part.num_rows, dtype=bool)
                for r, (x, y) in enumerate(zip(*sets, strict=True)):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    ok[r] = 100 * both >= percent * (len(x) + len(y) - both)
                good.append(ok)
            keep = pa.array(np.concatenate(good) if good else np.zeros(0, bool))
            yield batch.select(["a", "b"]).filter(keep)

    return _both(edges, texts, "text").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a bigint, b bigint")


class Sketches:
    """Parity sketches of many sets, those of one length as one matrix."""

    def __init__(self, size: np.ndarray, raw: list[bytes]) -> None:
        self.size = size
        self.words = np.fromiter((len(x) // 8 for x in raw), np.int64, len(raw))
        self.place = np.zeros(len(raw), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            mine = np.flatnonzero(self.words == w)
            self.place[mine] = np.arange(len(mine))
            self.of[w] = np.frombuffer(b"".join([raw[i] for i in mine.tolist()]), np.uint64).reshape(-1, w)

    def near(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs may be linked, by sizes and parities, and in how many bits these differ.

        Of two lengths the longer is folded, as bits are hashes modulo the length.
        """
        low, high = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        at = np.flatnonzero(100 * low >= percent * high)
        wi, wj = self.words[i[at]], self.words[j[at]]
        distance = np.zeros(len(at), np.int64)
        for a, b in {(int(x), int(y)) for x, y in np.unique(np.column_stack([wi, wj]), axis=0)}:
            mine = np.flatnonzero((wi == a) & (wj == b))
            step = max(1, (1 << 20) // max(a, b))
            for begin in range(0, len(mine), step):
                part = mine[begin : begin + step]
                x, y = self.of[a][self.place[i[at[part]]]], self.of[b][self.place[j[at[part]]]]
                short = min(a, b)
                x, y = (np.bitwise_xor.reduce(v.reshape(len(part), -1, short), axis=1) if v.shape[1] > short else v for v in (x, y))
                distance[part] = np.bitwise_count(x ^ y).sum(axis=1)
        good = distance * (100 + percent) <= (low[at] + high[at]) * (100 - percent)
        return at[good], distance[good]


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that can be reached, for every node of the edges (a, b)."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = stage(both)
    labels = stage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("y"), F.col("label").alias("other")), "y").groupBy(F.col("x").alias("node")).agg(F.min("other").alias("other"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = labels.join(seen, "node").join(jump, "label", "left")
        new = stage(new.select("node", F.least("label", "other", "up").alias("label"), (F.least("label", "other", "up") < F.col("label")).alias("moved")))
        drop(labels)
        labels = new
        if new.where("moved").isEmpty():
            drop(both)
            return labels


def _mixed(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Groups (group, node, label) whose members are not all of one label."""
    groups = groups.select("group", "node")
    if labels is None:
        return groups.withColumn("label", F.col("node"))
    named = groups.join(labels, "node", "left").select("group", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return named.join(mixed.select("group"), "group", "left_semi")


def _first_edges(mixed: DataFrame) -> DataFrame:
    """One edge (a, b) for each node that is not the first of all its groups: to the first one it shares most signatures with, of several the least."""
    heads = mixed.groupBy("group").agg(F.min(F.struct("node", "label")).alias("h")).select("group", F.col("h.node").alias("a"), F.col("h.label").alias("_l"))
    pairs = mixed.join(heads, "group").where("a < node and _l <> label").groupBy(F.col("node").alias("b"), "a").agg(F.sum("weight").alias("_w"))
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("_w", -F.col("a"))).alias("a")).select("a", "b")


def _partners(group: np.ndarray, side: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in order of group (a pair of blocks), side and label: (row, begin, end) of the ranges of rows that each is compared with. Those
    of other labels after it where sides are 0, else a row of side 1 with all of other labels of side 2. So pairs of one label cost nothing."""
    names, code = np.unique(label, return_inverse=True)
    n, to = len(names), group * 3 + np.where(side == 0, 0, 2)
    key = (group * 3 + side) * n + code.reshape(-1)
    own = to * n + code.reshape(-1)
    after, end = np.searchsorted(key, own, side="right"), np.searchsorted(key, (to + 1) * n)
    ones, rest = np.flatnonzero(side == 1), np.flatnonzero(side != 2)
    row = np.concatenate([ones, rest])
    begin = np.concatenate([np.searchsorted(key, to[ones] * n), after[rest]])
    return row, begin, np.concatenate([np.searchsorted(key, own[ones]), end[rest]])


def near_pairs(group: np.ndarray, side: np.ndarray, label: np.ndarray, sketches: Sketches, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one group, of different labels, that may be linked, and their distances. Rows are in order of group, side and label."""
    row, first, end = _partners(group, side, label)
    count = end - first
    total = np.cumsum(count)
    out_i, out_j, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(total, total[a] - count[a] + PAIRS, side="right")))
        n = count[a:b]
        i = np.repeat(row[a:b], n)
        j = np.repeat(first[a:b], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        found, distance = sketches.near(i, j, percent)
        out_i.append(i[found])
        out_j.append(j[found])
        out_d.append(distance)
        a = b
    return np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_d)


def forest(group: np.ndarray, label: np.ndarray, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows connect all that they connect, nearest first (Boruvka); rows of one group and label are connected already."""
    _, part = np.unique(np.column_stack([group, label]), axis=0, return_inverse=True)
    part = part.reshape(-1)
    x, y = part[i], part[j]
    chosen = []
    up = list(range(int(part.max()) + 1)) if len(part) else []

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    live = np.lexsort((np.arange(len(i)), distance))
    while len(live):
        # Pairs are in order of distance, so the first of a part is its nearest.
        firsts = np.concatenate([np.unique(x[live], return_index=True)[1], np.unique(y[live], return_index=True)[1]])
        for k in live[np.unique(firsts)].tolist():
            a, b = root(int(x[k])), root(int(y[k]))
            if a != b:
                up[max(a, b)] = min(a, b)
                chosen.append(k)
        roots = np.fromiter((root(v) for v in range(len(up))), np.int64, len(up))
        x, y = roots[x], roots[y]
        live = live[x[live] != y[live]]
    return np.array(chosen, dtype=np.int64)


def _close_edges(mixed: DataFrame, sketches: DataFrame, percent: int, step: str) -> DataFrame:
    """Edges (a, b, group) between nodes of different labels in a group whose sketches are near. A task takes a pair of blocks of a group at a time.

    ``within``: a forest of each block; ``across``: of each pair of blocks; ``rest``: all near pairs.
    """
    counts = mixed.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("_n"))
    rows = mixed.join(counts, "group").withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    if step == "within":
        rows = rows.withColumn("_x", F.col("_b"))
    else:
        rows = rows.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.select("group", F.least("_b", "_x").alias("low"), F.greatest("_b", "_x").alias("high"), F.when(F.col("_b") == F.col("_x"), 0).when(F.col("_b") < F.col("_x"), 1).otherwise(2).alias("side"), "node", "label")
    rows = rows.join(sketches.select("node", "size", "sketch").hint("merge"), "node").select("group", "low", "high", "side", "node", "label", "size", "sketch")
    parts = rows.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "side", "label")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table, until: int) -> pa.RecordBatch:
            keys = [table.column(i).to_numpy()[:until] for i in range(3)]
            side, node, label, size = (table.column(i).to_numpy()[:until] for i in range(3, 7))
            group = np.cumsum(np.append(False, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
            i, j, distance = near_pairs(group, side, label, Sketches(size, table.column(7).to_pylist()[:until]), percent)
            if step != "rest":
                chosen = forest(group, label, i, j, distance)
                i, j = i[chosen], j[chosen]
            x, y = node[i], node[j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(keys[0][i])], ["a", "b", "group"])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = [table.column(i).to_numpy() for i in range(3)]
            # The last pair of blocks may go on in the next batch.
            last = np.flatnonzero((keys[0] != keys[0][-1]) | (keys[1] != keys[1][-1]) | (keys[2] != keys[2][-1])) if table.num_rows else []
            if len(last):
                yield emit(table, int(last[-1]) + 1)
                held = table.slice(int(last[-1]) + 1).to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield emit(table, table.num_rows)

    return parts.mapInArrow(pairs, "a bigint, b bigint, group bigint")


def _class_texts(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """(node, text): texts with their classes, copies in a task once, without empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column("text")
            for i, j, data, offsets in chunks(batch, limit=SETS):
                name, seen = _unseen(set_classes(*shingle_sets(data, offsets, k, seed), j - i)[1], seen)
                at = np.flatnonzero(name)
                yield pa.RecordBatch.from_arrays([pa.array(name[at]), column.take(pa.array(at + i))], ["node", "text"])

    return docs.select("text").mapInArrow(run, "node bigint, text string")


def _texts(docs: DataFrame, nodes: DataFrame, k: int, seed: int, n: int) -> DataFrame:
    """(node, text): a text of each of the classes ``nodes``, in buckets of nodes: every round joins edges with it.

    Classes are made again, so that texts are shuffled once, by class. Both sides are dealt out alike, else the join would shuffle the texts again.
    """
    n = partitions_for(docs, n)
    rows = _class_texts(docs, k, seed).repartition(n, "node").join(nodes.repartition(n, "node").hint("merge"), "node", "left_semi")
    return stage_by(rows.groupBy("node").agg(F.first("text").alias("text")), "node", n)


def _labelled(docs: DataFrame, k: int, percent: int, level: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, class and label (of linked classes the least; 0: empty), a row per document, written."""
    sized = stage(_classes(docs, k, seed))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = bins_for(docs, size)
    groups = stage(_groups(docs, k, percent, n, level, seed))
    let_go(docs.sparkSession)
    nodes = stage(groups.select("node").distinct())
    sketches = stage(
        sized.join(nodes.select(F.col("node").alias("class")), "class", "left_semi").groupBy(F.col("class").alias("node")).agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    )
    texts = _texts(docs, nodes, k, seed, n)
    let_go(docs.sparkSession)
    links: DataFrame | None = None
    labels: DataFrame | None = None
    used = [sized, groups, nodes, sketches, texts]
    failed: list[DataFrame] = []
    tried: list[DataFrame] = []
    large = groups.groupBy("group").count().where(F.col("count") > PAIR_BLOCK).select("group")
    split = not large.isEmpty()
    for step in ("first", "within", "across", "rest"):
        if step == "first":
            edges = stage(_near(_first_edges(groups.withColumn("label", F.col("node"))), sketches, percent))
        elif step == "across" and not split or step == "rest" and not failed:
            continue
        else:
            # Where all edges of the forest of a group's near pairs are links, each of its near pairs is of one label by now.
            open_groups = {"within": None, "across": large, "rest": _union(failed).select("group").distinct() if failed else None}[step]
            mixed = stage(_mixed(groups if open_groups is None else groups.join(open_groups, "group", "left_semi"), labels))
            near = _close_edges(mixed, sketches, percent, step)
            if step == "rest":
                near = near.join(_union(tried), ["a", "b"], "left_anti")
            near = stage(near)
            edges = stage(near.select("a", "b").distinct())
            used += [mixed, near]
        used.append(edges)
        if edges.isEmpty():
            continue
        found = stage(_linked(edges, texts, k, percent, seed))
        used.append(found)
        if step in ("within", "across"):
            tried.append(edges)
            lost = stage(near.join(found, ["a", "b"], "left_anti"))
            used.append(lost)
            failed += [] if lost.isEmpty() else [lost]
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        drop(labels)
        labels = components(links)
        let_go(docs.sparkSession)
    if labels is None:
        out = stage(sized.select("doc_id", "n_shingles", "class", F.col("class").alias("label")))
    else:
        named = sized.join(labels.select(F.col("node").alias("class"), "label"), "class", "left")
        out = stage(named.select("doc_id", "n_shingles", "class", F.coalesce("label", "class").alias("label")))
    drop(*used, labels)
    let_go(docs.sparkSession)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def similarity_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """doc_id, n_shingles and component_id (least id that links reach), a row per document. Linked: Jaccard of ``percent`` or more.

    ``level``: differences that a part may have. Signatures get longer with it (6, 8, 10 shingles at 80 % for levels 1 to 3), so chance groups
    get rarer, but there are more of them; the result is the same.
    """
    docs = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    found = _labelled(docs, k, percent, level, new_seed())
    names = found.where("class <> 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = found.where("class <> 0").join(names, "label").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(found.where("class = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """The rows of ``docs`` without near copies, all columns as they are: of each component one row of least id stays (null ids
    come last). Rows with empty sets all stay."""
    seed = new_seed()
    found = _labelled(docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")), k, percent, level, seed)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("class").alias("cls"))
    stay = found.where("class <> 0").groupBy("label").agg(F.min(order).alias("s")).select(F.col("s.id").alias("_id"), F.col("s.cls").alias("_cls"))
    rows = with_class(docs, text_col, k, seed)
    same = (F.col("_class") == F.col("_cls")) & F.col(id_col).cast("bigint").eqNullSafe(F.col("_id"))
    kept = rows.join(stay.hint("merge"), same, "left").where("_class = 0 or _cls is not null").drop("_id", "_cls")
    if not found.where("class <> 0").groupBy("doc_id", "class").count().where("count > 1").isEmpty():
        kept = kept.where("_class <> 0").dropDuplicates([id_col, "_class"]).unionByName(kept.where("_class = 0"))
    return kept.drop("_class")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(documents(spark, sf_dir), k=4, percent=85)
