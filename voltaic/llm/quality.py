"""Host-level quality rules, with DataFrame functions only.

Every document gets rule failures; each host (``source``) gets the rate of its failing documents, shrunk
towards all hosts by a beta prior fitted to the hosts' own rates; host verdicts are joined back.

A document that fails a base rule (under 10 words, or over 20 % of its words in repeated five-word windows)
is rejected. One that fails only a soft rule (symbols, repeated lines, word length) is rejected where its host's
shrunk rate says that the host fails as a rule. A document that fails nothing is always kept.

Nulls: a null text has no words and fails; null sources form one host. Repeated rows and ids: a row each.
An empty table gives an empty result. Columns besides ``doc_id``, ``text`` and ``source`` are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WHITE, documents, let, stage

#: Words of a window that counts as repeated.
WINDOW = 5
#: A host whose shrunk rate of failing documents is over this is a bad one.
HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"


def _repeat_words(words: Column) -> Column:
    """How many of ``words`` lie in windows found twice or more."""

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(sorted_windows: Column) -> Column:
        same = F.filter(
            sorted_windows,
            lambda x, j: F.coalesce(F.get(sorted_windows, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_windows, j + 1)["h"] == x["h"], F.lit(False)),
        )
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def of_windows(windows: Column) -> Column:
        rows = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(rows, repeated))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _with_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with a struct ``_q`` of the counts that the rules look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.trim(F.col("_t"), F.lit(WHITE))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.trim(x, F.lit(WHITE)) != "")
    parts = docs.withColumn("_t", text).withColumns({"_w": F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+", -1)), "_l": lines})
    length = F.char_length
    counts = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        (length("_t") - length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
    )
    return parts.withColumn("_q", counts).drop("_t", "_w", "_l")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts that the rules look at, a row per document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    return _with_counts(rows, "text").select("doc_id", "host", "_q.*")


def base_failed(q: str = "") -> Column:
    return F.expr(f"{q}n_words < 10 or 100 * {q}n_repeat_words > 20 * {q}n_words")


def soft_failed(q: str = "") -> Column:
    """Symbols over a tenth of the letters, over 30 % repeated lines, or a mean word under 2 or over 20 letters."""
    return F.expr(f"10 * {q}n_symbols > {q}word_chars or 100 * {q}n_dup_lines > 30 * {q}n_lines or {q}word_chars < 2 * {q}n_words or {q}word_chars > 20 * {q}n_words")


def host_verdicts(scored: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """A row per host: its documents, failures, shrunk rate and verdict.

    The prior's mean and variance are those of the hosts' raw rates (method of moments); its weight is kept
    within 1 and 1,000,000 documents, so that one host alone, or hosts all alike, give a defined result.
    """
    # A row per host, used twice: written, so that the documents are counted once.
    hosts = stage(scored.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed")))
    raw = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(raw).alias("_m"), F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("_v"))
    prior = prior.select("_m", F.when(F.col("_v") > 0, F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1).otherwise(F.lit(1e6)).alias("_k"))
    prior = prior.select("_m", F.greatest(F.lit(1.0), F.least(F.lit(1e6), "_k")).alias("_k"))
    shrunk = (F.col("host_failed") + F.col("_m") * F.col("_k")) / (F.col("host_docs") + F.col("_k"))
    # The prior is one row, so this join adds no rows.
    joined = hosts.withColumn("_one", F.lit(1)).join(F.broadcast(prior.withColumn("_one", F.lit(1))), "_one")
    return joined.select("host", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk > rate).alias("host_bad"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts, rule failures, the host's shrunk rate and the verdict ``kept``, a row per document."""
    rows = features(docs, id_col, text_col, host_col)
    rows = rows.withColumns({"base_failed": base_failed(), "soft_failed": soft_failed()})
    # The counts are dear and small: computed once, then used for the hosts and for the documents.
    rows = stage(rows.withColumn("failed", F.col("base_failed") | F.col("soft_failed")))
    hosts = host_verdicts(rows).select(F.col("host").alias("_host"), "host_rate", "host_bad")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("soft_failed") & F.coalesce("host_bad", F.lit(False))))


def _failure() -> Column:
    """2 if a base rule fails, 1 if only a soft one does, else 0: one value, so that counts are not made again for each rule."""
    n = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"}

    def rule(q: Column) -> Column:
        c = {name: q[name] for name in n}
        base = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        soft = (10 * c["n_symbols"] > c["word_chars"]) | (100 * c["n_dup_lines"] > 30 * c["n_lines"]) | (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"])
        return F.when(base, 2).when(soft, 1).otherwise(0)

    # Never null, and said so: else a filter on it is inferred to need "is not null", which is pushed to the scan and counts all words once more.
    return F.coalesce(let(F.col("_q"), rule), F.lit(0))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are. Counts are made twice, so that texts are neither shuffled nor written in between."""
    rows = _with_counts(docs, text_col).withColumn("_f", _failure()).drop("_q")
    hosts = host_verdicts(rows.select(F.col(host_col).alias("host"), (F.col("_f") > 0).alias("failed")))
    bad = stage(hosts.where("host_bad").select(F.col("host").alias("_host"), F.lit(1).alias("_bad")))
    rows = rows.join(bad, rows[host_col].eqNullSafe(bad["_host"]), "left")
    return rows.where(F.col("_f") + F.coalesce("_bad", F.lit(0)) < 2).select(*(rows[c] for c in docs.columns))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same rows by SQL: words and windows are counted by grouping instead of by arrays.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, CASE WHEN trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN []
      ELSE regexp_split_to_array(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \t\n\x0B\f\r]+') END AS ws,
      list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words,
      length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN n USING (doc_id)),
v AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
      (10 * n_symbols > word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS soft_failed FROM f),
h AS (SELECT source, count(*) AS nd, sum((base_failed OR soft_failed)::INT) AS nf FROM v GROUP BY source),
p AS (SELECT m, greatest(1.0, least(1e6, CASE WHEN s > 0 THEN m * (1 - m) / s - 1 ELSE 1e6 END)) AS k
      FROM (SELECT avg(nf / nd) AS m, coalesce(var_samp(nf / nd), 0) AS s FROM h)),
b AS (SELECT source, (nf + m * k) / (nd + k) > 0.5 AS bad FROM h, p)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT (soft_failed AND bad)) AS kept
FROM v JOIN b ON v.source IS NOT DISTINCT FROM b.source
"""
