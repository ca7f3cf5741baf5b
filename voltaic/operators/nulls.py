"""Null distributions of the largest cluster over time, without maps of iterations.

A task takes a map's block of neighbouring samples, computes t of all iterations for it as arrays, and keeps of each iteration what its runs of significant samples
come to: the largest sum, the run that the block begins with, the one it ends with, and whether these are one (``Runs``). Runs of neighbouring blocks join by an associative
operator, so a map's blocks are merged in one stream, and what leaves a task is a few numbers an iteration, however many cells there are.

Draws come from numbers of the iteration and of the contribution (or trial), so every block of a map has the same ones, and so has a task that is run again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

#: Samples of a block, cells (iterations times trials) of labels and contributions with signs that are held at once.
WIDTH, LABELS, HELD = 64, 1 << 21, 256
#: Which of n maps each iteration draws: of the iterations' numbers, the contribution's and n.
Draw = Callable[[np.ndarray, int, int], np.ndarray]


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (the modified Lentz method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(2000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


@lru_cache(maxsize=4096)
def critical_t(alpha: float, df: float) -> float:
    """|t| beyond which the two-sided p is under alpha."""
    low, high = 0.0, 1.0
    p = lambda t: _beta(df / 2, 0.5, df / (df + t * t))
    while p(high) > alpha and high < 1e12:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if p(middle) > alpha else (low, middle)
    return high


@dataclass
class Runs:
    """Of each iteration: the largest |sum| of a run, the signed sums of those at either end (0: none), and whether one run is all there is."""

    best: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    whole: np.ndarray

    @staticmethod
    def of(t: np.ndarray, limit: np.ndarray | float) -> Runs:
        """Of t (iteration, sample): neighbouring samples of one sign with |t| over the limit."""
        t = np.where(np.abs(t) > limit, t, 0.0)  # not so where t is unknown
        n = len(t)
        best, head, now, unbroken = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n, bool)
        for i, x in enumerate(t.T):
            goes_on = (x * now > 0) if i else x != 0
            now = np.where(goes_on, now, 0.0) + x
            unbroken &= goes_on
            head = np.where(unbroken, now, head)
            best = np.maximum(best, np.abs(now))
        return Runs(best, head, now, unbroken)

    def then(self, other: Runs) -> Runs:
        """This and the block that follows."""
        joined = self.tail * other.head > 0
        sum_ = np.where(joined, self.tail + other.head, 0.0)
        return Runs(
            np.maximum(np.maximum(self.best, other.best), np.abs(sum_)), np.where(joined & self.whole, sum_, self.head),
            np.where(joined & other.whole, sum_, other.tail), joined & self.whole & other.whole,
        )


_RUNS = [StructField(c, ArrayType(DoubleType())) for c in ("best", "head", "tail")] + [StructField("whole", ArrayType(BooleanType()))]


def _packed(runs: Runs) -> list[pa.Array]:
    return [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (runs.best, runs.head, runs.tail)] + [pa.array([runs.whole.tolist()], pa.list_(pa.bool_()))]


def _key_fields(df: DataFrame, by: Sequence[str]) -> list[StructField]:
    return [df.schema[c] for c in by]


def _merged(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, iter, null): a map's blocks in order, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, runs = None, -2, None

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*current[1], pa.array([runs.best.tolist()], pa.list_(pa.float64()))], [*by, "_null"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            for i, key in enumerate(keys):
                new = Runs(*(batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("best", "head", "tail", "whole")))
                at = batch.column("_block")[i].as_py()
                if current is not None and current[0] == key:
                    if at == block:
                        raise ValueError(f"block {at} of {key} comes from two tasks")
                    if at != block + 1:  # samples that nothing is known of end a run
                        gap = np.zeros(len(new.best))
                        runs = runs.then(Runs(gap, gap, gap, gap > 0))
                    runs = runs.then(new)
                else:
                    if current is not None:
                        yield emit()
                    current, runs = (key, [batch.column(c).slice(i, 1) for c in by]), new
                block = at
        if current is not None:
            yield emit()

    fields = [*_key_fields(blocks, by), StructField("_null", ArrayType(DoubleType()))]
    parts = blocks.repartition(*by) if by else blocks.coalesce(1)
    out = parts.sortWithinPartitions(*by, "_block").mapInArrow(run, StructType(fields))
    return out.select(*by, F.posexplode("_null").alias("iter", "null"))


def hash_draw(seed: int = 41) -> Draw:
    def draw(iterations: np.ndarray, unit: int, n: int) -> np.ndarray:
        x = iterations.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((unit + seed * 0xBF58476D1CE4E5B9) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(n)).astype(np.int64)

    return draw


def group_null(pools: DataFrame, n_iter: int, by: Sequence[str], unit: str = "unit", alpha: float = 0.05, threshold: float | None = None, draw: Draw | None = None, draw_b: Draw | None = None, flip: bool = False, width: int = WIDTH) -> DataFrame:
    """(by, iter, null): of each iteration the largest |sum of t| over a run of significant samples of one sign, t of the contributions' mean against 0.

    ``pools``: by, unit (a number of the contribution), perm, t_idx and v; of each contribution an iteration draws one of its maps. With ``v_b`` it draws a second one, on its own, and the
    difference counts. ``flip``: a contribution has one map, and an iteration keeps it or turns its sign (of both conditions alike, where v is a difference).
    ``threshold``: |t| in place of ``alpha``. A task holds sums for iterations times ``width`` samples; contributions pass it one by one.
    """
    by, paired = list(by), "v_b" in pools.columns
    first, second = draw or hash_draw(), draw_b or hash_draw(43)
    conditions, blocks = ["v", "v_b"] if paired else ["v"], [*by, "_block"]
    perm = F.col("perm") if "perm" in pools.columns else F.lit(0)
    keys = [*by, F.expr(f"t_idx DIV {width}").alias("_block"), F.col(unit).cast("long").alias("_u")]
    rows = pools.select(*keys, perm.cast("long").alias("_p"), F.expr(f"t_idx % {width}").cast("long").alias("_t"), *(F.col(c).cast("double").alias(c) for c in conditions))
    for c in [*by, "_u"]:
        rows = rows.where(F.col(c).isNotNull())
    moved, value, n_maps = rows, F.struct(F.col("_p").alias("p"), F.col("_t").alias("t"), *conditions), {f"_n_{c}": F.lit(1) for c in conditions}
    if not flip:
        # How many maps a contribution has (in each condition): of all its samples, so that all its blocks draw alike. They go to the blocks with the values, as a row a contribution
        # and block; a join by contribution would shuffle the values by it, and then back.
        known = rows.groupBy(*blocks, "_u").agg(*(F.coalesce(F.max(F.when(F.col(c).isNotNull(), F.col("_p") + 1)), F.lit(0)).alias(f"_n_{c}") for c in conditions))
        sizes = known.select(*blocks, "_u", *(F.max(n).over(Window.partitionBy(*by, "_u")).alias(n) for n in n_maps))
        moved, value, n_maps = rows.unionByName(sizes, allowMissingColumns=True), F.when(F.col("_n_v").isNull(), value), {n: F.max(n) for n in n_maps}
    # Values are shuffled once, to the task of their block, and collected there.
    moved = moved.repartition(*blocks).withColumn("_s", value)
    arrays = moved.groupBy(*blocks, "_u").agg(F.collect_list("_s").alias("_s"), *(x.alias(n) for n, x in n_maps.items()))
    iterations = np.arange(n_iter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        n = total = squares = np.zeros((1, 0))
        held: list[tuple[np.ndarray, np.ndarray]] = []  # turned contributions: signs and samples

        def turn() -> None:
            nonlocal n, total, squares
            if held:
                signs, v = np.stack([x for x, _ in held], axis=1), np.stack([x for _, x in held])
                known, v = ~np.isnan(v), np.nan_to_num(v, nan=0.0)
                # Neither numbers nor squares depend on signs.
                n, total, squares = n + known.sum(axis=0), total + signs @ v, squares + (v * v).sum(axis=0)
                held.clear()

        def emit() -> pa.RecordBatch:
            turn()
            used = max(1, int(np.flatnonzero((n > 0).any(axis=0)).max(initial=-1)) + 1)
            k, s, q = n[:, :used], total[:, :used], squares[:, :used]
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = s / k
                t = mean / np.sqrt(np.maximum(q - k * mean**2, 0) / (k - 1) / k)
                t = np.where((k >= 2) & np.isfinite(t), t, np.nan)
            if threshold is None:
                values, place = np.unique(k, return_inverse=True)
                limit = np.array([critical_t(alpha, x - 1) if x >= 2 else math.inf for x in values.tolist()])[place.reshape(k.shape)]
            else:
                limit = threshold
            runs = Runs.of(t, limit)
            if used < width:  # the rest of the block is unknown
                runs = runs.then(Runs.of(np.zeros((n_iter, 1)), 0.0))
            return pa.RecordBatch.from_arrays([*current[1], *_packed(runs)], [*by, "_block", "best", "head", "tail", "whole"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in [*by, "_block"]), strict=True))
            lists = batch.column("_s")
            for i, key in enumerate(keys):
                if current is None or current[0] != key:
                    if current is not None:
                        yield emit()
                    current = key, [batch.column(c).slice(i, 1) for c in [*by, "_block"]]
                    n, total, squares = np.zeros((1 if flip else n_iter, width)), np.zeros((n_iter, width)), np.zeros((1 if flip else n_iter, width))
                part, u = lists.slice(i, 1).flatten(), batch.column("_u")[i].as_py()
                p, at = part.field("p").to_numpy(), part.field("t").to_numpy()
                maps, sizes = [], []
                for c in ("v", "v_b") if paired else ("v",):
                    sizes.append(batch.column(f"_n_{c}")[i].as_py() or 0)
                    maps.append(np.full((max(int(p.max()) + 1, sizes[-1]), width), np.nan))
                    maps[-1][p, at] = part.field(c).to_numpy(zero_copy_only=False)
                if not all(sizes):  # one of the conditions has no map at all
                    continue
                if flip:
                    held.append((np.where(first(iterations, u, 2) == 0, 1.0, -1.0), maps[0][0] - maps[1][0] if paired else maps[0][0]))
                    if len(held) >= HELD:
                        turn()
                    continue
                w = int(at.max()) + 1
                drawn = maps[0][:, :w][first(iterations, u, sizes[0])]
                if paired:
                    drawn = drawn - maps[1][:, :w][second(iterations, u, sizes[1])]
                known = ~np.isnan(drawn)
                drawn = np.where(known, drawn, 0.0)
                n[:, :w] += known
                total[:, :w] += drawn
                squares[:, :w] += drawn * drawn
        if current is not None:
            yield emit()

    fields = [*_key_fields(arrays, [*by, "_block"]), *_RUNS]
    parts = arrays.sortWithinPartitions(*by, "_block", "_u")
    return _merged(parts.mapInArrow(run, StructType(fields)), by)


def hash_order(seed: int = 17) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keys (iteration, trial) by which trials are ordered."""
    draw = hash_draw(seed)

    def order(iterations: np.ndarray, trials: np.ndarray) -> np.ndarray:
        return np.stack([draw(iterations, int(t), 1 << 62) for t in trials], axis=1)

    return order


def label_null(values: DataFrame, n_iter: int, by: Sequence[str], a: str = "A", b: str = "B", threshold: float = 2.0, order: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, subject: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """(subject, by, iter, null): as above, for Welch's t of two conditions whose labels are dealt anew to the subject's trials (all of them, whatever a map lacks).

    ``values``: subject, by, trial (a number), condition, t_idx, v. The k-th trial in an iteration's order gets the label of the k-th trial by number. ``threshold``: |t| of a significant
    sample. A task holds a subject's trials for ``width`` samples of a map, and labels of some iterations at a time.
    """
    by, subject = list(by), list(subject)
    order = order or hash_order()
    side = F.when(F.col("condition") == a, 1).when(F.col("condition") == b, 2).otherwise(0)
    # Labels of all of the subject's trials go to each of its blocks: trials, not values.
    labels = values.select(*subject, F.col("trial").cast("long").alias("trial"), side.alias("s")).distinct().groupBy(*subject).agg(F.array_sort(F.collect_list(F.struct("trial", "s"))).alias("_l"))
    rows = values.where("v is not null").select(*subject, *by, F.expr(f"t_idx DIV {width}").alias("_block"), F.struct(F.col("trial").cast("long").alias("trial"), F.expr(f"t_idx % {width}").cast("long").alias("t"), F.col("v").cast("double").alias("v")).alias("_s"))
    blocks = rows.groupBy(*subject, *by, "_block").agg(F.collect_list("_s").alias("_s"))
    joined = blocks.join(labels, subject) if subject else blocks.join(F.broadcast(labels.withColumn("_one", F.lit(0))), F.col("_block") >= F.col("_one")).drop("_one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known = batch.column("_l").slice(i, 1).flatten()
                trials, sides = known.field("trial").to_numpy(), known.field("s").to_numpy()
                part = batch.column("_s").slice(i, 1).flatten()
                at = np.searchsorted(trials, part.field("trial").to_numpy()), part.field("t").to_numpy()
                v, there = np.zeros((len(trials), width)), np.zeros((len(trials), width))
                v[at], there[at] = part.field("v").to_numpy(), 1.0
                # Around each sample's mean, so that squares lose no digits.
                v = np.where(there > 0, v - v.sum(axis=0) / np.maximum(there.sum(axis=0), 1), 0.0)
                parts: list[Runs] = []
                step = max(1, LABELS // len(trials))
                for begin in range(0, n_iter, step):
                    iterations = np.arange(begin, min(begin + step, n_iter))
                    # Ties go to the lesser trial.
                    ranked = np.argsort(order(iterations, trials), axis=1, kind="stable")
                    dealt = np.empty(ranked.shape, np.int8)
                    np.put_along_axis(dealt, ranked, np.broadcast_to(sides.astype(np.int8), ranked.shape), axis=1)
                    means, errors, enough = [], [], True
                    with np.errstate(divide="ignore", invalid="ignore"):
                        for code in (1, 2):
                            m = (dealt == code).astype(float)
                            n, s, q = m @ there, m @ v, m @ (v * v)
                            means.append(s / n)
                            errors.append(np.maximum(q - s * s / n, 0) / (n - 1) / n)
                            enough = enough & (n >= 2)
                        t = (means[0] - means[1]) / np.sqrt(errors[0] + errors[1])
                    parts.append(Runs.of(np.where(enough & np.isfinite(t), t, np.nan), threshold))
                runs = Runs(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("best", "head", "tail", "whole")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in [*subject, *by, "_block"]), *_packed(runs)], [*subject, *by, "_block", "best", "head", "tail", "whole"])

    fields = [*_key_fields(joined, [*subject, *by, "_block"]), *_RUNS]
    return _merged(joined.mapInArrow(run, StructType(fields)), [*subject, *by])


