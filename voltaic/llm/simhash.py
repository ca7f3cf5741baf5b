"""SimHash near duplicates by multi-index hashing.

A text's fingerprint has a bit for each of 64: set if over half of its word shingles' hashes (repeats included) have it. Two
fingerprints are linked at two differing bits or fewer. Each has two segments of 32 bits, so of a linked pair

A. the first segments are equal, and the second ones differ in two bits at most;
B. or the first segments differ in one bit, and the second ones in one at most;
C. or the second segments are equal, and the first ones differ in two.

Tables hold the fingerprints by a segment; probes enumerate the Hamming ball of radius 1 around the first segment (one of two
neighbours probes the other: that with the bit) and of radius 0 around the second. What may still differ is less than the pieces of
the other segment (three of them, or two in B), so one piece is equal as well and is a part of the key. A key then has 2**22 different
fingerprints at the very most, whatever the corpus: no key needs to be split, and none is cut short.

Copies are one node from the start. Matches of a key are never paired with each other: all that lie within one bit of the same value are
within two bits of each other, so each is linked with the least of them, its complete distance verified, and a task sends on one edge
for each fingerprint and component that it sees.

Nulls, empty texts and texts without words have fingerprint zero and are linked like any other; texts of fewer words than a shingle
are one shingle. Repeated rows are copies. Rows with a null id are linked but never name a component (theirs is null if all are).
Texts are taken whole. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, drop, stage
from ._words import LOWER
from .jaccard import components

#: Words of a shingle, the hash's seed, and differing bits that links have at most.
WORDS, SEED, DISTANCE = 3, 42, 2
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16
_LOWER = LOWER.tobytes()
_HALF = np.uint64(0xFFFFFFFF)
#: Pieces of a segment as (first bit, bits).
THIRDS, HALVES = ((0, 11), (11, 11), (22, 10)), ((0, 16), (16, 16))
#: The value itself and all that differ from it in one of 32 bits.
BALL = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(32, dtype=np.uint64)])


def fingerprint(text: bytes, k: int = WORDS) -> int:
    """Of one text in UTF-8."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, ends = [0, *ends[: max(0, len(words) - k)]], [e - 1 for e in ends[min(k, len(words)) - 1 :]]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends)), repeat(SEED)), "<u8", len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), AT_ONCE):
        counts += np.unpackbits(hashes[i : i + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``fp`` (the 64 bits as a signed number), a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary() if batch.column(1).type == pa.string() else pa.large_binary())
            found = np.fromiter((fingerprint(x.as_py() or b"", k) for x in raw), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def _key(kind: int, segment: np.ndarray, other: np.ndarray, piece: tuple[int, int]) -> np.ndarray:
    first, bits = piece
    part = (other >> np.uint64(first)) & np.uint64((1 << bits) - 1)
    return np.uint64(kind << 48) | segment << np.uint64(16) | part


def table_and_probes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) of what each fingerprint puts into the tables and of its probes."""
    high, low = fp >> np.uint64(32), fp & _HALF
    keys = [_key(i, high, low, p) for i, p in enumerate(THIRDS)] + [_key(3 + i, low, high, p) for i, p in enumerate(THIRDS)] + [_key(6 + i, high, low, p) for i, p in enumerate(HALVES)]
    of = [fp] * len(keys)
    for bit in BALL[1:]:
        mine = (high & bit) != 0
        for i, p in enumerate(HALVES):
            keys.append(_key(6 + i, high[mine] ^ bit, low[mine], p))
            of.append(fp[mine])
    return np.concatenate(keys), np.concatenate(of)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the edges (a, b) with the least one that it reaches, where that is another."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label < np.arange(len(node))
    return node[moved], node[label[moved]]


def matches(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all linked fingerprints of a key; rows are in order of key."""
    same = key[1:] == key[:-1]
    shared = np.append(False, same) | np.append(same, False)
    key, fp = key[shared], fp[shared]
    kind = key >> np.uint64(48)
    segment = (key >> np.uint64(16)) & _HALF
    group = np.cumsum(np.append(0, key[1:] != key[:-1])).astype(np.uint64)[: len(key)]
    # What may differ within a key: the segment that is not in it.
    rest = np.where((kind >= 3) & (kind < 6), fp >> np.uint64(32), fp & _HALF)
    probe = (kind >= 6) & (fp >> np.uint64(32) != segment)
    width = np.where(probe, 1, len(BALL))
    owner = np.repeat(np.arange(len(key)), width)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
    middle = rest[owner] ^ BALL[step]
    by = np.lexsort((fp[owner], middle, group[owner]))
    owner, middle = owner[by], middle[by]
    begins = np.append(True, (group[owner[1:]] != group[owner[:-1]]) | (middle[1:] != middle[:-1]))[: len(owner)]
    least = owner[np.flatnonzero(begins)[np.cumsum(begins) - 1]] if len(owner) else owner
    a, b = fp[least], fp[owner]
    good = (a != b) & (np.bitwise_count(a ^ b) <= DISTANCE)
    a, b = a[good].view(np.int64), b[good].view(np.int64)
    return _stars(a, b) if len(a) else (a, b)


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect whatever fingerprints ``fp`` (distinct ones) links connect."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp = table_and_probes(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(rows: np.ndarray) -> pa.RecordBatch:
            a, b = matches(rows[0].view(np.uint64), rows[1].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield found(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            held.append(rows[:, cut:])
        if held:
            yield found(np.concatenate(held, axis=1))

    sent = nodes.select("fp").mapInArrow(send, "key bigint, fp bigint")
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the least id that links reach), a row per document."""
    prints = stage(fingerprints(docs, k, id_col, text_col))
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = stage(links(nodes))
    if edges.isEmpty():
        names = nodes.select("fp", F.col("low").alias("component_id"))
    else:
        labels = components(edges).select(F.col("node").alias("fp"), "label")
        named = stage(nodes.join(labels.hint("merge"), "fp", "left"))
        linked = named.where("label is not null")
        least = linked.groupBy("label").agg(F.min("low").alias("component_id"))
        # Fingerprints without links, most of them, name themselves.
        alone = named.where("label is null").select("fp", F.col("low").alias("component_id"))
        names = alone.unionByName(linked.join(least.hint("merge"), "label").select("fp", "component_id"))
    names = stage(names)
    drop(edges)
    out = prints.join(names.hint("merge"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
