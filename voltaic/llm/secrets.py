"""Secret scan by one combined automaton over all rules.

``RULES`` are compiled together (see ``automaton``). Texts of a batch are joined by line ends and cut into lanes
after bytes that lead to the start from every state; the lanes advance together, one table lookup per byte, so each
byte is read once for all rules. Where a rule's run of end states stops, a backward automaton finds its
leftmost start and a forward one its end.

Nulls and empty texts have no spans. Repeated rows are rows of their own; very long texts are taken whole.
An empty table gives an empty result. Columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chunks, documents
from .automaton import Automaton, compile_rules, parse

#: Kind, pattern, whether letters fold, and what a found match must also fit. Lengths stand there,
#: for a run that is counted from every start at once makes very many states; only ``hex``, found in most words, counts.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    ("access", r"AKIA[A-Z0-9]+", False, r"AKIA[A-Z0-9]{16,}"),
    ("hex", r"[0-9a-f]{24,}", False, None),
    ("github", r"gh[opsu]_[A-Za-z0-9]+", False, r"gh[opsu]_[A-Za-z0-9]{36,}"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google", r"AIza[0-9A-Za-z_-]+", False, r"AIza[0-9A-Za-z_-]{35,}"),
    ("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", False, None),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, None),
]
KINDS = [r[0] for r in RULES]
#: The kinds that every scan has; the others add spans.
BASE = ("assign", "access", "hex")
#: Lanes are about this long.
LANE = 2048


def _steps(a: Automaton) -> tuple[list[list[int]], list[int], int]:
    """Transitions, ends and the dead state (-1: none) as plain lists, for walks over single matches."""
    table = a.by_byte
    dead = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1) & (a.ends == 0))
    return table.tolist(), a.ends.tolist(), int(dead[0]) if len(dead) else -1


@lru_cache(maxsize=1)
def compiled() -> tuple:
    """The combined automaton (transitions, byte classes, ends, classes that reset it), and each rule's own forward and backward ones.

    It takes seconds, so the driver does it once and tasks get the arrays (2 MB, bounded by the rules)."""
    trees = [parse(p, fold) for _, p, fold, _ in RULES]
    both = compile_rules(trees)
    own = []
    for (_, _, fold, must), tree in zip(RULES, trees, strict=True):
        forward = compile_rules([tree, *([parse(must, fold)] if must else [])], anchored=True)
        back = compile_rules([tree], anchored=True, backward=True)
        own.append(tuple(_steps(a) for a in (forward, back)))
    width = both.table.shape[1]
    resets = (both.table == 0).all(axis=0)
    assert resets[both.classes[10]], "line ends must lead to the start"
    return both.table.reshape(-1) * width, both.classes, both.ends.astype(np.uint32), resets, own


def _states(data: np.ndarray, table: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """The state after each byte; ``data`` has byte classes."""
    n, width = len(data), np.int32(len(resets))
    out = np.zeros(n, dtype=np.uint16)
    stops = np.flatnonzero(resets[data]) + 1
    cuts = np.searchsorted(stops, np.arange(LANE, n, LANE))
    starts = np.unique(np.concatenate([[0], stops[cuts[cuts < len(stops)]]]))
    starts = starts[starts < n]
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    at, lengths = starts[order].astype(np.int64), lengths[order]
    # Lanes are sorted, so those longer than k come first.
    live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    state = np.zeros(len(at), dtype=np.int32)
    for k, m in enumerate(live.tolist()):
        if m != len(at):
            at, state = at[:m], state[:m]
        state = table[state + data[at]]
        out[at] = state // width
        at += 1
    return out


def _matches(data: bytes, stops: list[int], own: tuple) -> Iterator[tuple[int, int]]:
    """Leftmost-longest spans, none over another, of one rule in one text; ``stops``: where runs of its end states stop."""
    (forward, f_ends, f_dead), (back, b_ends, b_dead) = own
    checked = any(x & 2 for x in f_ends)
    done = 0
    for stop in stops:
        if stop <= done:
            continue
        state, start = 0, -1
        for i in range(stop - 1, done - 1, -1):
            state = back[state][data[i]]
            if state == b_dead:
                break
            if b_ends[state]:
                start = i
        if start < 0:
            continue
        state, found = 0, 0
        for i in range(start, len(data)):
            state = forward[state][data[i]]
            if state == f_dead:
                break
            if f_ends[state]:
                done, found = i + 1, f_ends[state]
        if not checked or found & 2:
            yield start, done


def find_secrets(batch: list[bytes] | pa.RecordBatch, rules: tuple, text_col: str = "text") -> Iterator[list[tuple[int, int, str]]]:
    """For each text of a batch its spans (start, end, kind) in bytes, by start and then by kind."""
    table, classes, ends, resets, own = rules
    if isinstance(batch, list):
        batch = pa.RecordBatch.from_arrays([pa.array(batch, pa.large_binary()).cast(pa.large_string())], [text_col])
    for i, j, data, offsets in chunks(batch, text_col):
        breaks = offsets[1:] + np.arange(j - i)
        joined = np.full(len(data) + j - i, 10, dtype=np.uint8)
        text = np.ones(len(joined), dtype=bool)
        text[breaks] = False
        joined[text] = data
        ending = ends[_states(classes[joined], table, resets)]
        falls = ending & ~np.append(ending[1:], np.uint32(0))
        at = np.flatnonzero(falls)
        rows = np.searchsorted(breaks, at)
        spans: dict[int, list[tuple[int, int, str]]] = {}
        for rule in range(len(RULES)):
            mine = (falls[at] >> np.uint32(rule)) & 1 == 1
            for row in np.unique(rows[mine]).tolist():
                first = int(offsets[row])
                stops = (at[mine & (rows == row)] + 1 - row - first).tolist()
                raw = data[first : int(offsets[row + 1])].tobytes()
                spans.setdefault(row, []).extend((a, b, KINDS[rule]) for a, b in _matches(raw, stops, own[rule]))
        for row in range(j - i):
            yield sorted(spans.get(row, ()), key=lambda s: (s[0], KINDS.index(s[2])))


def _points(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in code points instead of bytes."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), int(before[b]), k) for a, b, k in spans]


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``secrets``: an array of (kind, start, end) in code points, a row per document."""

    rules = compiled()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            column = batch.column(1)
            found = [
                [{"kind": k, "start": a, "end": b} for a, b, k in (_points(column[row].as_py(), spans) if spans else ())]
                for row, spans in enumerate(find_secrets(batch, rules))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "secrets"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {id_type}, secrets array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``documents`` with every secret's span replaced by ``mark``; overlapping spans become one. Null texts stay null."""

    rules = compiled()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column, out = batch.column(at), None
            for row, spans in enumerate(find_secrets(batch, rules)):
                if spans:
                    out = out if out is not None else column.to_pylist()
                    raw, parts, end = out[row].encode(), [], 0
                    for a, b, _ in spans:
                        if a >= end:
                            parts += [raw[end:a], mark.encode()]
                        end = max(end, b)
                    out[row] = b"".join([*parts, raw[end:]]).decode()
            yield batch if out is None else batch.set_column(at, batch.schema.field(at), pa.array(out, column.type))

    return docs.mapInArrow(scan, docs.schema)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _count(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(_count(k) for k in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
