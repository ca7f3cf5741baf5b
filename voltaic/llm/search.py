"""Ranked lexical search over a tiered index.

Every posting (term, document) has an impact; a term weighs its impacts. The index has a row per document, and in it a column of
postings for each tier: a term's highest impacts are in the first, up to a number of them, and so on; what a tier leaves has a residual
bound for each term, the highest impact that it may still have. So a tier is read by reading its columns alone.

1. Over the first tier, the ``k``-th best sum of what was found is a floor: the last place of the result scores that much at least.
2. A document's bound is what was found and the residuals of the terms that weren't. If only few documents reach the floor by their
   bounds, and documents without any posting in the tier can't, these few are proven to hold the result, and only they are scored
   from all tiers.
3. Items without this proof fall through to the next tier, with its floors and bounds, and at last to all tiers, where scores are exact
   and a task sends on the ``k`` best documents of an item that reach its floor.

Sums are 64-bit integers, so they don't depend on the order of documents or tiers. The items are the query set, taken in blocks of
``BLOCK`` bytes of text and ``ITEMS`` items at most, small enough to be sent to every task; an index has the terms of a block. Terms are
64-bit hashes, keyed by a number drawn for each block.

A null text has no terms; a text or an item without terms matches nothing. Repeated documents are rows of their own, so are repeated
items; of equal scores the smaller id comes first, null ids last. Texts are taken whole. Empty tables give an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ._common import chunks, documents, drop, stage
from ._words import ALPHANUMERIC, new_seed, split_words
from .decontamination import _member

#: Documents of a result, bytes of items' text and items of a block, postings that a term has in the first tier and in the first two.
K, BLOCK, ITEMS, TIERS = 20, 1 << 20, 4096, (4096, 65536)
#: Documents that an item's proof may leave to be scored.
LEFT = 200
#: Impacts are below 10**6; a level has 2**LEVEL of them.
LEVEL, LEVELS = 15, 32
#: Sums (documents times items) and steps of them that are held at once, and rows before only the best are kept.
SUMS, STEPS, HELD = 1 << 21, 1 << 22, 1 << 18


@dataclass
class Items:
    """The terms of some items: sorted hashes, and of each (item, term) the number of times, in order of term."""

    seed: int
    terms: np.ndarray
    code: np.ndarray
    item: np.ndarray
    times: np.ndarray
    n: int

    def weighed(self, weight: np.ndarray, chosen: np.ndarray) -> Queries:
        """The chosen items, numbered anew."""
        place = np.full(self.n, -1, np.int64)
        place[chosen] = np.arange(len(chosen))
        mine = (place[self.item] >= 0) & (weight[self.code] > 0)
        code = self.code[mine]
        return Queries(np.searchsorted(code, np.arange(len(self.terms) + 1)), place[self.item[mine]], self.times[mine] * weight[code], code, len(chosen))


@dataclass
class Queries:
    """For each term, the items that have it and its weight in them (rows begin[term] to begin[term + 1])."""

    begin: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    code: np.ndarray
    n: int

    def bound(self, residual: np.ndarray) -> np.ndarray:
        """What a document without any posting may score at most."""
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.item, self.weight * residual[self.code])
        return out

    def sums(self, doc: np.ndarray, code: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """Of each document and item, the weighted values of the postings (document, term, value)."""
        out = np.zeros(n_docs * self.n, np.int64)
        count = self.begin[code + 1] - self.begin[code]
        owner = np.repeat(np.arange(len(code)), count)
        which = np.repeat(self.begin[code] - (np.cumsum(count) - count), count) + np.arange(len(owner))
        np.add.at(out, doc[owner] * self.n + self.item[which], value[owner] * self.weight[which])
        return out.reshape(n_docs, self.n)


def read_items(texts: list[str | None], seed: int) -> Items:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, _, data, offsets in chunks(batch):
        w = split_words(data, offsets, ALPHANUMERIC, lower=True, seed=seed)
        hashes.append(w.hash)
        rows.append(w.row + i)
    terms, code = np.unique(np.concatenate(hashes), return_inverse=True)
    pair, times = np.unique(code * max(1, len(texts)) + np.concatenate(rows), return_counts=True)
    return Items(seed, terms, pair // max(1, len(texts)), pair % max(1, len(texts)), times, len(texts))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of little-endian 32-bit integers."""
    raw = np.ascontiguousarray(values, "<i4").tobytes()
    offsets = np.append(0, np.cumsum(counts * 4)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]).cast(pa.binary())


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of such rows, and how many each has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, "<i4", count=int(offsets[-1] - offsets[0]) // 4, offset=int(offsets[0])) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, "<i4")
    return raw.astype(np.int64), np.diff(offsets) // 4


def _postings(docs: DataFrame, items: Items) -> DataFrame:
    """row (a number of its own), doc_id, n (terms) and the items' terms with their occurrences, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, codes, times, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, data, offsets in chunks(batch):
                w = split_words(data, offsets, ALPHANUMERIC, lower=True, seed=items.seed)
                at, key = _member(w.hash, items.terms)
                pair, tf = np.unique(w.row[at] * max(1, len(items.terms)) + key, return_counts=True)
                n.append(w.counts())
                codes.append(pair % max(1, len(items.terms)))
                times.append(tf)
                counts.append(np.bincount(pair // max(1, len(items.terms)), minlength=j - i))
            count = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), _lists(np.concatenate(codes), count), _lists(np.concatenate(times), count)], ["doc_id", "n", "codes", "times"])

    rows = docs.mapInArrow(run, "doc_id bigint, n bigint, codes binary, times binary")
    return rows.select(F.monotonically_increasing_id().alias("row"), "*")


def _impacts(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, impact) of the postings of (n, codes, times), and how many each document has."""
    codes, count = _values(batch.column("codes"))
    tf, _ = _values(batch.column("times"))
    m = 75 + 25 * batch.column("n").to_numpy() * n_docs // max(1, n_terms)
    doc = np.repeat(np.arange(batch.num_rows), count)
    return doc, codes, 1_000_000_000 * tf // (1000 * tf + 12 * m[doc]), count


def _levels(postings: DataFrame, n_docs: int, n_terms: int, n_codes: int) -> np.ndarray:
    """How many postings each term has at each level of impact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, code, impact, _ = _impacts(batch, n_docs, n_terms)
            place, n = np.unique(code * LEVELS + (impact >> LEVEL), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(n)], ["place", "n"])

    # As many rows as the block has terms and levels at most.
    found = postings.select("n", "codes", "times").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_codes * LEVELS, np.int64)
    out[found["place"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out.reshape(n_codes, LEVELS)


def tier_cuts(levels: np.ndarray, tiers: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each tier but the last and each term: the lowest level in it, and the highest impact that is left for later ones."""
    from_top = levels[:, ::-1].cumsum(axis=1)[:, ::-1]
    cuts, residuals = [], []
    for most in tiers:
        cut = LEVELS - (from_top <= most).sum(axis=1)
        below = (levels > 0) & (np.arange(LEVELS) < cut[:, None])
        top = np.where(below.any(axis=1), LEVELS - 1 - below[:, ::-1].argmax(axis=1), -1)
        cuts.append(cut)
        residuals.append(np.where(top >= 0, ((top + 1) << LEVEL) - 1, 0))
    return np.stack(cuts), np.stack(residuals)


def _tiered(postings: DataFrame, cuts: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """row, doc_id, and codes and impacts of each tier."""
    n_tiers = len(cuts) + 1
    names = [x for t in range(n_tiers) for x in (f"codes{t}", f"impacts{t}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, code, impact, _ = _impacts(batch, n_docs, n_terms)
            tier = (impact >> LEVEL < cuts[:, code]).sum(axis=0)
            columns = [batch.column("row"), batch.column("doc_id")]
            for t in range(n_tiers):
                mine = tier == t
                count = np.bincount(doc[mine], minlength=batch.num_rows)
                columns += [_lists(code[mine], count), _lists(impact[mine], count)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *names])

    return postings.mapInArrow(run, "row bigint, doc_id bigint, " + ", ".join(f"{x} binary" for x in names))


def _read(batch: pa.RecordBatch, tiers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, impact) of the postings in the first ``tiers`` tiers, in order of document."""
    parts = [(_values(batch.column(f"codes{t}")), _values(batch.column(f"impacts{t}"))[0]) for t in range(tiers)]
    doc = np.concatenate([np.repeat(np.arange(batch.num_rows), count) for (_, count), _ in parts])
    by = np.argsort(doc, kind="stable")
    return doc[by], np.concatenate([c for (c, _), _ in parts])[by], np.concatenate([v for _, v in parts])[by]


def _scored(batch: pa.RecordBatch, tiers: int, q: Queries, residual: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, sums of it and those that follow by item), some documents at a time. With residuals: bounds."""
    doc, code, value = _read(batch, tiers)
    base = 0
    if residual is not None:
        value, base = value - residual[code], q.bound(residual)
    steps = np.append(0, np.cumsum(q.begin[code + 1] - q.begin[code]))
    first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    a, most = 0, max(1, SUMS // max(1, q.n))
    while a < batch.num_rows:
        b = max(a + 1, min(a + most, int(np.searchsorted(steps[first], steps[first[a]] + STEPS, side="right")) - 1))
        mine = slice(first[a], first[b])
        yield a, q.sums(doc[mine] - a, code[mine], value[mine], b - a) + base
        a = b


def _columns(tiers: int, *more: str) -> list[str]:
    return [*more, *(x for t in range(tiers) for x in (f"codes{t}", f"impacts{t}"))]


def _floors(index: DataFrame, tiers: int, q: Queries, k: int) -> np.ndarray:
    """For each item, the k-th best of the documents' sums over some tiers (0: fewer documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((k, q.n), np.int64)
        for batch in batches:
            for _, sums in _scored(batch, tiers, q):
                best = np.partition(np.concatenate([best, sums]), -k, axis=0)[-k:]
        at, item = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[at, item])], ["item", "score"])

    rows = index.select(_columns(tiers)).mapInArrow(run, "item bigint, score bigint")
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("_r") <= k).where(F.col("_r") == k)
    out = np.zeros(q.n, np.int64)
    for r in last.select("item", "score").toLocalIterator():  # one for each item of the block
        out[r.item] = r.score
    return out


def _proven(index: DataFrame, tiers: int, q: Queries, residual: np.ndarray, floor: np.ndarray) -> DataFrame:
    """(item, row): documents whose bounds reach their item's floor, of the items that have ``LEFT`` of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(q.n, np.int64)
        held = [np.zeros((2, 0), np.int64)]
        for batch in batches:
            row = batch.column("row").to_numpy()
            for a, bounds in _scored(batch, tiers, q, residual):
                at, item = np.nonzero(bounds >= floor)
                # An item with more than that has no proof, so what it has beyond that needs not be sent.
                open_ = seen[item] <= LEFT
                held.append(np.stack([item[open_], row[a + at[open_]]]))
                seen += np.bincount(item, minlength=q.n)
        x = np.concatenate(held, axis=1)
        x = x[:, seen[x[0]] <= LEFT]
        x = x[:, np.argsort(x[0], kind="stable")]
        mine = np.flatnonzero(seen)
        ends = np.searchsorted(x[0], mine, side="right")
        rows = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(x[0], mine[:1]), ends).astype(np.int32)), pa.array(x[1]))
        yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(seen[mine]), rows], ["item", "n", "rows"])

    parts = index.select(_columns(tiers, "row")).mapInArrow(run, "item bigint, n bigint, rows array<bigint>")
    few = parts.withColumn("_n", F.sum("n").over(Window.partitionBy("item"))).where(F.col("_n") <= LEFT)
    return few.select("item", F.explode("rows").alias("row"))


SCORED = "item bigint, row bigint, doc_id bigint, score bigint"


def _best(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Of rows (item, order of id, row, score) the k best of each item."""
    x = np.concatenate(parts, axis=1)
    x = x[:, np.lexsort((x[2], x[1], -x[3], x[0]))]
    begin = np.flatnonzero(np.append(True, x[0][1:] != x[0][:-1]))[: len(x[0])]
    rank = np.arange(x.shape[1]) - np.repeat(begin, np.diff(np.append(begin, x.shape[1])))
    return x[:, rank < k]


def _all_tiers(index: DataFrame, tiers: int, q: Queries, floor: np.ndarray, numbers: np.ndarray, k: int) -> DataFrame:
    """Exact scores of the k best documents of each item in each task."""
    floor = np.maximum(floor, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [np.zeros((4, 0), np.int64)], 0
        for batch in batches:
            row = batch.column("row").to_numpy()
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            for a, sums in _scored(batch, tiers, q):
                at, item = np.nonzero(sums >= floor)
                held.append(np.stack([item, ids[a + at], row[a + at], sums[at, item]]))
                count += len(at)
                if count >= HELD:
                    held = [_best(held, k)]
                    count = held[0].shape[1] - q.n * k
        item, ids, row, score = _best(held, k)
        doc = pa.array(ids, mask=ids == np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[item] if len(item) else item), pa.array(row), doc, pa.array(score)], ["item", "row", "doc_id", "score"])

    return index.select(_columns(tiers, "row", "doc_id")).mapInArrow(run, SCORED)


def _few(index: DataFrame, tiers: int, q: Queries, left: DataFrame) -> DataFrame:
    """Exact scores of the documents ``left`` (item, row): ``LEFT`` for each item of the block at most, so they can be sent to every task."""
    wanted = left.groupBy("row").agg(F.collect_list("item").alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            item = lists.flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            score = np.zeros(len(doc), np.int64)
            for a, sums in _scored(batch, tiers, q):
                mine = (doc >= a) & (doc < a + len(sums))
                score[mine] = sums[doc[mine] - a, item[mine]]
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(item), batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(score)], ["item", "row", "doc_id", "score"])

    return index.join(F.broadcast(wanted), "row").select(_columns(tiers, "row", "doc_id", "items")).mapInArrow(run, SCORED).where("score > 0")


def _search_block(docs: DataFrame, texts: list[str | None], k: int, tiers: tuple[int, ...]) -> DataFrame | None:
    """item (its place among ``texts``), row, doc_id and score of documents that include the k best of each item."""
    items = read_items(texts, new_seed())
    if not len(items.terms):
        return None
    postings = stage(_postings(docs, items))
    n_docs, n_terms = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    levels = _levels(postings, n_docs, n_terms, len(items.terms))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) if df else 0 for df in levels.sum(axis=1).tolist()], np.int64)
    cuts, residuals = tier_cuts(levels, tiers)
    index = stage(_tiered(postings, cuts, n_docs, n_terms))
    drop(postings)
    n_tiers, open_ = len(tiers) + 1, np.arange(items.n)
    floor = np.zeros(items.n, np.int64)
    found: list[DataFrame] = []
    for t, residual in enumerate(residuals):
        if not len(open_):
            break
        floor[open_] = np.maximum(floor[open_], _floors(index, t + 1, items.weighed(weight, open_), k))
        # Without a posting in these tiers a document must not reach the floor, else any may be in the result.
        may = open_[items.weighed(weight, open_).bound(residual) < floor[open_]]
        if not len(may):
            continue
        q = items.weighed(weight, may)
        left = stage(_proven(index, t + 1, q, residual, floor[may]))
        done = np.array(sorted(r.item for r in left.select("item").distinct().toLocalIterator()), np.int64)  # items of the block at most
        if len(done):
            numbers = items.weighed(weight, may)
            scored = _few(index, n_tiers, numbers, left)
            named = F.element_at(F.lit([int(x) for x in may]), (F.col("item") + 1).cast("int")).cast("bigint")
            found.append(scored.withColumn("item", named))
            open_ = np.setdiff1d(open_, may[done])
    if len(open_):
        found.append(_all_tiers(index, n_tiers, items.weighed(weight, open_), floor[open_], open_, k))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in blocks; the driver holds one at a time."""
    block, size = [], 0
    for item in items.toLocalIterator():
        n = len((item[1] or "").encode())
        if block and (size + n > BLOCK or len(block) >= ITEMS):
            yield block
            block, size = [], 0
        block.append((item[0], item[1]))
        size += n
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item (all, if fewer score)."""
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    items = items.select(items[item_col].alias("item_id"), items[item_text_col].alias("text"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    kind = items.schema["item_id"].dataType
    out = spark.createDataFrame([], StructType([StructField("item_id", kind), StructField("rank", IntegerType())])).withColumns({"doc_id": F.lit(None).cast("bigint"), "score": F.lit(None).cast("bigint")})
    for block in _blocks(items):
        found = _search_block(docs, [text for _, text in block], k, tiers)
        if found is None:
            continue
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], StructType([StructField("item", IntegerType()), StructField("item_id", kind)]))
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same by SQL, without tiers.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
total AS (SELECT count(*) FILTER (len(w) > 0) AS docs, coalesce(sum(len(w)), 0)::BIGINT AS terms FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, n, term),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, total GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY item_id, term),
scored AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
           FROM q JOIN weight USING (term) JOIN tf USING (term), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
