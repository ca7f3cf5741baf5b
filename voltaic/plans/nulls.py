"""Queries of null distributions of clusters, with their SQL. Draws are arithmetic here, so that both engines make the same ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import nulls
from .statistics import _AB, _DEAL, _WELCH
from .tables import EPOCHS, epochs, rounded

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {EPOCHS} {sql.strip()}"
        return f

    return add


def _draw(step: int) -> nulls.Draw:
    return lambda iterations, unit, n: (iterations + 1) * (unit * 7919 + step) % 99991 % n


def _order(iterations: np.ndarray, trials: np.ndarray) -> np.ndarray:
    return (trials[None, :] + 1) * (iterations[:, None] * 7919 + 104729) % 99991


#: From t (iter, feature, t_idx): sums of runs of one sign over the limit, and the largest of each iteration.
_NULL = """, z AS (SELECT iter, feature, t_idx, t, sign(t) AS sg FROM {t} WHERE abs(t) > {limit}),
 u AS (SELECT *, t_idx - row_number() OVER (PARTITION BY iter, feature, sg ORDER BY t_idx) AS g FROM z),
 c AS (SELECT iter, feature, abs(sum(t)) AS s FROM u GROUP BY iter, feature, sg, g)
 SELECT k.feature, k.iter, round(coalesce(max(s), 0), 6) AS "null" FROM (SELECT DISTINCT iter, feature FROM {t}) k LEFT JOIN c ON k.iter = c.iter AND k.feature = c.feature GROUP BY ALL"""
_T = "avg(v) / nullif(stddev_samp(v) / sqrt(count(v)), 0)"


@query(""", f AS (SELECT iter::BIGINT AS iter, feature, t_idx, v * CASE WHEN (iter + 1) * (trial * 7919 + 104729) % 99991 % 2 = 0 THEN 1 ELSE -1 END AS v FROM e, range(50) AS r(iter)),
 t AS (SELECT iter, feature, t_idx, """ + _T + " AS t FROM f GROUP BY ALL)" + _NULL.format(t="t", limit=0.8))
def null_of_flips(spark: SparkSession, d: str) -> DataFrame:
    rows = epochs(spark, d).select("feature", F.col("trial").alias("unit"), "t_idx", "v")
    return rounded(nulls.group_null(rows, 50, ["feature"], threshold=0.8, draw=_draw(104729), flip=True, width=3))


_POOL = """, m AS (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY trial) - 1 AS perm FROM e), n AS (SELECT label, feature, max(perm) FILTER (v IS NOT NULL) + 1 AS n FROM m GROUP BY ALL)"""


def _pools(spark: SparkSession, d: str) -> DataFrame:
    """Labels as contributions, their trials as stored maps, features as regions."""
    perm = F.dense_rank().over(Window.partitionBy("label").orderBy("trial")) - 1
    return epochs(spark, d).select("feature", F.col("label").alias("unit"), perm.alias("perm"), "t_idx", "v", "x")


@query(_POOL + """, f AS (SELECT iter::BIGINT AS iter, m.feature, t_idx, v FROM m JOIN n USING (label, feature), range(50) AS r(iter) WHERE perm = (iter + 1) * (label * 7919 + 104729) % 99991 % n),
 t AS (SELECT iter, feature, t_idx, """ + _T + " AS t FROM f GROUP BY ALL)" + _NULL.format(t="t", limit=0.6))
def null_of_stored_maps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nulls.group_null(_pools(spark, d).drop("x"), 50, ["feature"], threshold=0.6, draw=_draw(104729), width=3))


@query(_POOL + """, a AS (SELECT iter::BIGINT AS iter, m.feature, label, t_idx, v FROM m JOIN n USING (label, feature), range(50) AS r(iter) WHERE perm = (iter + 1) * (label * 7919 + 104729) % 99991 % n),
 b AS (SELECT iter::BIGINT AS iter, m.feature, label, t_idx, v * x AS v FROM m JOIN n USING (label, feature), range(50) AS r(iter) WHERE perm = (iter + 1) * (label * 7919 + 15485863) % 99991 % n),
 f AS (SELECT a.iter, a.feature, a.t_idx, a.v - b.v AS v FROM a JOIN b ON a.iter = b.iter AND a.feature = b.feature AND a.label = b.label AND a.t_idx = b.t_idx),
 t AS (SELECT iter, feature, t_idx, """ + _T + " AS t FROM f GROUP BY ALL)" + _NULL.format(t="t", limit=0.6))
def null_of_paired_maps(spark: SparkSession, d: str) -> DataFrame:
    """Maps against maps times the trial's predictor, drawn on their own."""
    rows = _pools(spark, d).withColumn("v_b", F.col("v") * F.col("x")).drop("x")
    return rounded(nulls.group_null(rows, 50, ["feature"], threshold=0.6, draw=_draw(104729), draw_b=_draw(15485863), width=3))


@query(_DEAL.format(n=20) + _AB.format(k="perm, feature, t_idx", src="pe") + f", tm AS (SELECT perm AS iter, feature, t_idx, (ma - mb) / nullif(sqrt({_WELCH}), 0) AS t FROM s)" + _NULL.format(t="tm", limit=0.7))
def null_of_labels(spark: SparkSession, d: str) -> DataFrame:
    """Dealt labels as in ``perm_t_maps``, but an iteration leaves one number of each feature."""
    return rounded(nulls.label_null(epochs(spark, d), 20, ["feature"], threshold=0.7, order=_order, width=3))
