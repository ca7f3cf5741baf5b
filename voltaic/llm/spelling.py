"""Spelling variants of a vocabulary by wildcard groups, without making pairs.

Words are the corpus's runs of letters, counted; two are near if one code point was inserted, deleted or replaced. A word stands in a
group for each of its positions, keyed by (position, what comes before, what comes after): the members of such a group are
replacements of each other, and its size and its two best words tell each member how many there are and which is best. A word's
distinct deletions meet the vocabulary: each one found there is near to the word, and the word found learns the number and the best of
those that lead to it. What groups say of a word is summed up; no two words are ever put into one row.

A group has as many members as there are letters (90), and a word has so many longer ones by a deletion as letters times places, so
groups are small however large the corpus is.

Keys are polynomials over the code points, modulo a prime of 127 bits, at a point drawn for each query: one multiplication for each
position, so a very long word costs its length and not its square. Words have numbers in order of frequency, then of code points, so
the better of two words is the one of the lesser number.

A null text has no words; a null id counts as an empty one. Repeated rows count again. Texts are taken whole. An empty table gives
an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
import secrets
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, drop, stage
from ._words import LOWER

#: Code points and occurrences that a word has at least, how many times commoner a form is, and one in how many occurrences loses a code point.
LEAST, OCCURRENCES, TIMES, DAMAGE = 7, 2, 10, 31
#: Letters, once A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
_PRIME = (1 << 127) - 1
#: Stands for any code point; none is so large.
_ANY = 1 << 21
#: Keys of a batch that is sent on.
BATCH = 1 << 17
WILD, SHORTER, WHOLE = 0, 1, 2
_LOWER = LOWER.tobytes()


def words_of(doc_id: object, text: str, runs: re.Pattern[str]) -> Counter[str]:
    """How often the text has each word, after one in ``DAMAGE`` (id, run) have lost a code point."""
    out: Counter[str] = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs.findall(text.encode().translate(_LOWER).decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST:
            out[run] += n
    return out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n (occurrences in all documents), of those that have enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run of fewer code points can't become a word.
        runs = re.compile(f"[{LETTERS}]{{{LEAST},}}")
        for batch in batches:
            total: Counter[str] = Counter()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    total.update(words_of(doc_id, text.as_py(), runs))
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


class Keys:
    """Keys of words' wildcards and deletions."""

    def __init__(self, point: int) -> None:
        self.point, self.powers = point, [1]

    def of(self, word: str) -> tuple[int, list[int], list[int]]:
        """Of the word itself, of it with any code point at each position, and without each (once for a run of equal ones)."""
        codes = [ord(c) + 1 for c in word]
        n, powers = len(codes), self.powers
        while len(powers) < n:
            powers.append(powers[-1] * self.point % _PRIME)
        whole, before = 0, [0]
        for c in codes:
            whole = (whole * self.point + c) % _PRIME
            before.append(whole)
        wild = [(whole + (_ANY - c) * powers[n - 1 - i]) % _PRIME for i, c in enumerate(codes)]
        shorter = [(whole + (before[i] - before[i + 1]) * powers[n - 1 - i]) % _PRIME for i, c in enumerate(codes) if not i or codes[i - 1] != c]
        return whole, wild, shorter


def _keyed(words: DataFrame, point: int) -> DataFrame:
    """(a, b: the key; role; id) of every word, each of its positions and each of its deletions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(point)
        held: list[int] = []
        roles: list[int] = []
        counts: list[int] = []
        ids: list[int] = []

        def emit() -> pa.RecordBatch:
            pairs = np.frombuffer(b"".join([k.to_bytes(16, "little") for k in held]), "<i8").reshape(-1, 2)
            out = pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.repeat(np.array(roles, np.int8), counts)), pa.array(np.repeat(np.array(ids, np.int64), counts))], ["a", "b", "role", "id"]
            )
            for x in (held, roles, counts, ids):
                x.clear()
            return out

        for batch in batches:
            for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole, wild, shorter = keys.of(word)
                for role, found in ((WHOLE, [whole]), (WILD, wild), (SHORTER, shorter)):
                    held += found
                    roles.append(role)
                    counts.append(len(found))
                    ids.append(i)
                if len(held) >= BATCH:
                    yield emit()
        if held:
            yield emit()

    return words.select("id", "word").mapInArrow(run, "a bigint, b bigint, role tinyint, id bigint")


def near_counts(words: DataFrame) -> DataFrame:
    """id, n_near and ``best`` (the least number of its near words) of each of ``words`` (id, word) that has any."""
    point = (1 << 64) + secrets.randbelow(_PRIME - (1 << 65))
    group = Window.partitionBy("a", "b").orderBy("role", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    members = _keyed(words, point).withColumns(
        {
            "size": F.count(F.lit(1)).over(group), "first": F.first("id").over(group), "second": F.nth_value("id", 2).over(group),
            "word_id": F.max(F.when(F.col("role") == WHOLE, F.col("id"))).over(group),
        }
    )
    # A group is of wildcards, or of deletions and (last, by its role) the one word that they make.
    told = members.where("size > 1").select(
        "id",
        F.when(F.col("role") == SHORTER, F.when(F.col("word_id").isNotNull(), 1)).otherwise(F.col("size") - 1).alias("n_near"),
        F.when(F.col("role") == SHORTER, F.col("word_id")).when((F.col("role") == WILD) & (F.col("first") == F.col("id")), F.col("second")).otherwise(F.col("first")).alias("best"),
    )
    return told.where("n_near > 0").groupBy("id").agg(F.sum("n_near").cast("bigint").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): forms are followed to the last. Each is ``TIMES`` commoner than the one before, so ways are short, and each round doubles the step."""
    roots = stage(forms.select("id", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        further = stage(roots.join(on.hint("merge"), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(roots)
        roots = further
        if roots.where("moved").isEmpty():
            return roots.select("id", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form (its commonest near word, if that is ``TIMES`` as common), root (the last form), n, n_near and form_n, a row per word."""
    counted = count_words(docs, id_col, text_col).orderBy(F.desc("n"), "word")
    # Numbers rise with the order of the rows.
    words = stage(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    near = stage(near_counts(words))
    target = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    own = words.join(near.hint("merge"), "id", "left")
    known = own.where("best is not null").join(target.hint("merge"), "best")
    chosen = stage(known.where(F.col("form_n") >= TIMES * F.col("n")).select("id", "best", "form", "form_n"))
    roots = _roots(chosen.select("id", F.col("best").alias("form")))
    rooted = stage(roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")).hint("merge"), "root").select("id", "root_word"))
    out = own.join(chosen.select("id", "form", "form_n").hint("merge"), "id", "left").join(rooted.hint("merge"), "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


#: The same by SQL, with pairs. The checksum is taken byte by byte from a table that its polynomial makes.
OP12_SQL = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
                       lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, tab
), vocab AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (
  SELECT word, n, left(word, i - 1) AS x, substr(word, i + 1) AS y FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)
), shorter AS (SELECT DISTINCT word, n, x || y AS d FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n FROM places a JOIN places b USING (x, y) WHERE a.word <> b.word
  UNION SELECT s.word, v.word, v.n FROM shorter s JOIN vocab v ON s.d = v.word
  UNION SELECT v.word, s.word, s.n FROM shorter s JOIN vocab v ON s.d = v.word
), best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN (SELECT min(other) FROM near x WHERE x.word = v.word AND x.n = top) END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n
  FROM vocab v LEFT JOIN best b ON v.word = b.word
), way AS (
  SELECT word, word AS reached, 0 AS step FROM formed
  UNION ALL SELECT w.word, f.form, step + 1 FROM way w JOIN formed f ON w.reached = f.word WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(reached, step) AS root FROM way GROUP BY word)
SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed f JOIN roots r ON f.word = r.word
"""
