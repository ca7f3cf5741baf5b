"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Both dictionaries share ordinary content trained by zstandard; before it, one has content trained on toxic texts of which only the words
are left that recur in them and hardly in ordinary ones, the other ordinary content of the same size. (Trained on whole toxic texts,
the toxic dictionary is mostly ordinary language, and its gains are noise: the README has the figures of both forms.) A window is one
word (64 bytes of it at most) with a space on either side and padding, since zstandard finds no matches in a
window's last bytes. Its gain is the compressed length with the ordinary dictionary less that with the toxic one.
A text's score comes from how many of its windows pass each gain threshold, by logistic weights calibrated on labelled texts
that the dictionaries were not trained on, and set to the labels' own rate.

The classifier is fitted on the driver on a bounded sample of labelled rows (``TOXIC`` and ``ORDINARY`` texts, of
``SAMPLE_BYTES`` at most each); it is the same size for any corpus. Every whole text is scored.

Nulls and empty texts have no windows; their score is the weights' value for that. Repeated rows are rows of their
own, an empty table gives an empty result, and without labels of both kinds every score is the labels' rate (0 without
labels). Columns besides ``doc_id``, ``text`` and ``toxic`` are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents

#: The sample of labelled texts that the classifier is fitted on, at most.
TOXIC, ORDINARY, SAMPLE_BYTES = 2000, 6000, 60_000
#: Bytes of the toxic dictionary, and of the ordinary content that both share.
TOXIC_DICT, SHARED_DICT = 2048, 16384
LEVEL = 3
#: A word is taken for the toxic dictionary if so many toxic texts have it, and so many times more often than ordinary ones.
RECURS, RATIO = 5, 20
#: Gains that are counted.
GAINS = (2, 3, 4, 5, 6)
PAD = b" " * 12
LONGEST = 64
#: Distinct windows whose gain a Python worker remembers at most; it bounds memory only.
CACHE = 1_000_000
THRESHOLD = 0.3
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")


def windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    if any(len(w) > LONGEST for w in words):
        return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


@dataclass
class Model:
    """Dictionaries' contents and weights: small, sent with each task."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    _known: dict[bytes, int] = field(default_factory=dict, repr=False)
    _tools: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_tools": None}

    def gain(self, window: bytes) -> int:
        if self._tools is None:
            self._tools = tuple(_compressor(d) for d in (self.ordinary, self.toxic))
        a, b = self._tools
        padded = b" " + window + b" " + PAD
        return len(a.compress(padded)) - len(b.compress(padded))

    def features(self, text: bytes) -> list[float]:
        known, counts, n = self._known, Counter(), 0
        for w, k in Counter(windows(text)).items():
            gain = known.get(w)
            if gain is None:
                if len(known) >= CACHE:
                    known.clear()
                gain = known[w] = self.gain(w)
            n += k
            if gain > 1:
                counts[min(gain, GAINS[-1])] += k
        at_least = np.cumsum([counts[g] for g in reversed(GAINS)])[::-1]
        return [*np.log1p(at_least), *(np.sqrt(at_least / max(n, 1))), np.log1p(n)]

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)


def _trained(size: int, samples: list[bytes], k: int) -> bytes:
    """Content of a trained dictionary; too few samples are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-9] + [penalty] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[bytes], ordinary: list[bytes], rate: float) -> Model:
    """Dictionaries from seven tenths of the distinct texts, weights from the rest. ``rate``: of toxic texts among all labelled ones."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    size = 2 * len(GAINS) + 1
    if len(toxic) < 2 or len(ordinary) < 2:
        logit = np.log(rate / (1 - rate)) if 0 < rate < 1 else (30.0 if rate else -30.0)
        return Model(b" " * 16, b" " * 16, np.zeros(size), np.ones(size), np.array([logit] + [0.0] * size))
    cut_t, cut_o = max(1, len(toxic) * 7 // 10), max(1, len(ordinary) * 7 // 10)
    in_toxic, in_ordinary = Counter(), Counter()
    for texts, found in ((toxic[:cut_t], in_toxic), (ordinary[:cut_o], in_ordinary)):
        for t in texts:
            found.update(set(_LETTERS.findall(t.lower())))
    marked = {w for w, c in in_toxic.items() if c >= min(RECURS, cut_t) and c / cut_t > RATIO * (in_ordinary[w] + 0.5) / cut_o}
    samples = [b" " + b" ".join(words) + b" " for t in toxic[:cut_t] if (words := list(dict.fromkeys(w for w in _LETTERS.findall(t.lower()) if w in marked)))]
    content = _trained(TOXIC_DICT, samples, 16)
    parts = [t[i : i + 1024].lower() for t in ordinary[:cut_o] for i in range(0, len(t), 1024)]
    shared = _trained(SHARED_DICT + TOXIC_DICT, parts, 64)
    model = Model(shared, content + shared[len(content) :], np.zeros(size), np.ones(size), np.zeros(size + 1))
    x = np.array([model.features(t) for t in (*toxic[cut_t:], *ordinary[cut_o:])])
    y = np.array([1.0] * (len(toxic) - cut_t) + [0.0] * (len(ordinary) - cut_o))
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    model.weights = _logistic((x - model.mean) / model.scale, y)
    share = y.mean()
    if 0 < rate < 1:
        model.weights[0] += np.log(rate / (1 - rate)) - np.log(share / (1 - share))
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY) -> Model:
    """Fit on at most so many labelled texts, those of lowest hash among the rows that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    order = F.xxhash64("doc_id")
    few = known.where("toxic = 1").orderBy(order, "doc_id").limit(toxic).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(ordinary))
    # A row for each sampled id, whatever the size of the tables: of rows that share an id the least text.
    rows = docs.select("doc_id", "text").join(F.broadcast(few.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))), "doc_id").where(F.octet_length("text").between(1, SAMPLE_BYTES))
    rows = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    texts = sorted((r["doc_id"], r["toxic"], r["text"]) for r in rows.collect())
    rng = np.random.default_rng(0)
    rng.shuffle(texts)
    split = [[t.encode() for _, y, t in texts if y == k] for k in (1, 0)]
    return fit(*split, counts["t"] / counts["n"] if counts["n"] else 0.0)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``score``, a row per document."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    import pickle

    raw = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _loaded(raw)
        for batch in batches:
            x = np.array([mine.features((t or "").encode()) for t in batch.column(1).to_pylist()]).reshape(-1, 2 * len(GAINS) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mine.score(x), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


@lru_cache(maxsize=1)
def _loaded(raw: bytes) -> Model:
    """A worker keeps the model, and the gains that it remembers, from task to task."""
    import pickle

    return pickle.loads(raw)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
