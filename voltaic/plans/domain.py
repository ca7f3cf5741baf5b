"""Queries of events, trials, rules, catalogs, channels and regions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import half_away, half_even
from ..operators import catalog as ct
from ..operators import epochs as ep
from ..operators import groups as gr
from ..operators import predicates as pr
from ..operators import trials as tr
from ..sources import sinks
from ..streaming import rates
from . import pipelines
from .tables import ANNOTATIONS, EPOCHS, annotations, epochs, read, rounded

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Events and time


@query(f"WITH {ANNOTATIONS}, b AS (SELECT *, min(onset) FILTER (code = 'signup') OVER w AS s, max(onset) FILTER (code = 'purchase') OVER w AS f FROM a WINDOW w AS (PARTITION BY recording)) SELECT event_id, recording, onset FROM b WHERE code IN ('click', 'view') AND onset > s AND onset < f")
def anchor_bounds(spark: SparkSession, d: str) -> DataFrame:
    return tr.anchors_within(annotations(spark, d), ["click", "view"], "signup", "purchase").select("event_id", "recording", "onset")


@query(f"WITH {ANNOTATIONS}, s AS (SELECT event_id, recording, onset // 36000 AS sample, code <> 'error' AS keep FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY recording, sample, keep ORDER BY event_id) AS r FROM s) SELECT event_id, sample, keep AND r = 1 AS keep, CASE WHEN keep AND r > 1 THEN 'duplicate_anchor_sample' END AS exclusion_reason FROM r")
def anchor_dedup(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d).select("event_id", "recording", F.expr("onset DIV 36000").alias("sample"), (F.col("code") != "error").alias("keep"), F.lit(None).cast("string").alias("exclusion_reason"))
    return tr.mark_duplicate_anchors(a, order="event_id").select("event_id", "sample", "keep", "exclusion_reason")


@query(f"WITH {ANNOTATIONS}, x AS (SELECT * FROM a WHERE code = 'click'), y AS (SELECT * FROM a WHERE code <> 'click') SELECT x.event_id, y.event_id AS event_event_id FROM x JOIN y ON x.recording = y.recording AND y.onset BETWEEN x.onset - 1800 AND x.onset + 7200")
def interval_event_join(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d)
    return tr.events_in_window(a.where("code = 'click'"), a.where("code <> 'click'"), -1800, 7200).select("event_id", "event_event_id")


_COUNTS = f"WITH {ANNOTATIONS}, x AS (SELECT * FROM a WHERE code = 'click'), y AS (SELECT * FROM a WHERE code = 'error'), n AS (SELECT x.event_id, count(y.event_id) AS n_events FROM x LEFT JOIN y ON x.recording = y.recording AND y.onset BETWEEN x.onset AND x.onset + 86400 GROUP BY ALL)"


@query(_COUNTS + " SELECT event_id, n_events, n_events < 2 AS keep, CASE WHEN n_events >= 2 THEN 'artefacts' END AS exclusion_reason FROM n")
def event_count_invalidation(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d)
    counted = tr.event_counts(a.where("code = 'click'"), a.where("code = 'error'"), "event_id", 0, 86400)
    counted = counted.withColumns({"keep": F.lit(True), "exclusion_reason": F.lit(None).cast("string")})
    return tr.invalidate_by_count(counted, 2, "artefacts").select("event_id", "n_events", "keep", "exclusion_reason")


@query(f"WITH {ANNOTATIONS}, x AS (SELECT *, lead(onset) OVER (PARTITION BY recording ORDER BY onset, event_id) AS nx FROM a WHERE code = 'view') SELECT event_id, (SELECT min(r.onset) FROM a r WHERE r.code = 'click' AND r.recording = x.recording AND r.onset > x.onset AND (x.nx IS NULL OR r.onset < x.nx)) AS response FROM x")
def next_response_asof(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d)
    return tr.next_response(a.where("code = 'view'"), a.where("code = 'click'"), "event_id").select("event_id", "response")


@query(f"WITH {ANNOTATIONS} SELECT event_id, recording, onset - floor(epoch(ts))::BIGINT AS gap FROM a JOIN events USING (event_id) WHERE code = 'purchase'")
def nearest_onset_join(spark: SparkSession, d: str) -> DataFrame:
    """Anchors find their own rows, within a thousandth of a second."""
    a = annotations(spark, d).where("code = 'purchase'").withColumn("onset", F.col("onset").cast("double"))
    rows = a.withColumn("onset", F.col("onset") + F.when(F.col("event_id") % 2 == 0, 0.0004).otherwise(-0.0004)).withColumn("code", F.when(F.col("event_id") % 3 > 0, F.col("code")))
    found = tr.nearest_rows(a, rows, "event_id", "event_id")
    return found.select(F.col("row").alias("event_id"), "recording", F.floor("gap").cast("long").alias("gap"))


@query(f"WITH {ANNOTATIONS}, s AS (SELECT *, round(onset * 0.512, 0)::BIGINT AS q FROM a) SELECT event_id, round((onset % 100000 + 3)::DOUBLE / 1000 * 64, 0)::BIGINT AS sample_quantized, round((((onset % 100000) + 3 + 1)::DOUBLE / 1000) * 64 - 1, 0)::BIGINT AS spm FROM a")
def event_resample(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("onset") % 100000
    return annotations(spark, d).select("event_id", tx.resample_onset(s, 1000.0, 64.0, 3).alias("sample_quantized"), tx.resample_onset(s, 1000.0, 64.0, 3, "spm_continuous_sample").alias("spm"))


_TEXTS = "CASE WHEN event_id % 5 = 0 THEN 'Stimulus/S  ' || lpad((event_id % 40)::VARCHAR, 3, '0') WHEN event_id % 5 = 1 THEN 'Response/R ' || (event_id % 7)::VARCHAR WHEN event_id % 5 = 2 THEN 'Comment/' || event_type WHEN event_id % 5 = 3 THEN (event_id % 90)::VARCHAR ELSE 'Comment/0' || (event_id % 9)::VARCHAR END"


def _texts() -> Column:
    i = F.col("event_id")
    return (
        F.when(i % 5 == 0, F.concat(F.lit("Stimulus/S  "), F.lpad((i % 40).cast("string"), 3, "0"))).when(i % 5 == 1, F.concat(F.lit("Response/R "), (i % 7).cast("string")))
        .when(i % 5 == 2, F.concat(F.lit("Comment/"), "event_type")).when(i % 5 == 3, (i % 90).cast("string")).otherwise(F.concat(F.lit("Comment/0"), (i % 9).cast("string")))
    )


_PARSED = f"""WITH t AS (SELECT event_id, {_TEXTS} AS x FROM events), p AS (SELECT event_id, x, CASE WHEN contains(x, '/') THEN split_part(x, '/', 1) ELSE 'Stimulus' END AS kind, CASE WHEN contains(x, '/') THEN split_part(x, '/', 2) ELSE x END AS description FROM t),
 c AS (SELECT *, CASE WHEN kind IN ('Stimulus', 'Response') THEN regexp_extract(description, '(\\d+)$', 1) ELSE regexp_extract(description, '^(\\d+)$', 1) END AS g FROM p), k AS (SELECT *, CASE WHEN g <> '' THEN (g::BIGINT)::VARCHAR END AS code FROM c)"""


@query(_PARSED + " SELECT event_id, kind, description, code FROM k")
def annotation_parse(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", _texts().alias("x"))
    p = t.select("event_id", tx.annotation_type(F.col("x")).alias("kind"), tx.annotation_description(F.col("x")).alias("description"))
    return p.withColumn("code", tx.annotation_code(F.col("kind"), F.col("description")))


@query(_PARSED + " SELECT event_id, (x = '7' OR description = '7' OR coalesce(code = '7', FALSE)) AS hit FROM k")
def annotation_code_match(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", _texts().alias("x"))
    return t.select("event_id", tx.matches_code(F.col("x"), F.lit("7")).alias("hit"))


# Rules


RULE = {"all": [{"column": "c_mktsegment", "op": "in", "values": ["building", " Machinery"]}, {"any": [{"column": "c_acctbal", "op": "between", "values": [100, 5000]}, {"not": {"column": "c_nationkey", "op": "<", "value": 10}}]}]}
CONDITIONS = [
    {"label": "rich", "when": {"column": "balance", "op": ">=", "value": 4000}},
    {"label": "near", "when": {"all": [{"column": "nation", "op": "in", "values": [1, 2, 3, 4, 5, 6]}, {"column": "balance", "op": "<", "value": 7000}]}},
]


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AND (c_acctbal BETWEEN 100 AND 5000 OR NOT c_nationkey < 10) AS matched FROM customer")
def rule_compile_all_any_not(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select("c_custkey", pr.compile_rule(pr.validate(RULE), c.columns)["matched"].alias("matched"))


_ROWS = "r AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN 'many' ELSE c_acctbal::VARCHAR END AS balance, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_nationkey::VARCHAR END AS nation FROM customer)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    balance = F.when(k % 17 == 0, "").when(k % 19 == 0, "many").otherwise(F.col("c_acctbal").cast("string"))
    return read(spark, d, "customer").select("c_custkey", balance.alias("balance"), F.when(k % 23 != 0, F.col("c_nationkey").cast("string")).alias("nation"))


_CLASSED = f"""WITH {_ROWS}, m AS (SELECT *, try_cast(balance AS DOUBLE) AS b, try_cast(nation AS DOUBLE) AS n FROM r),
 q AS (SELECT *, coalesce(b >= 4000, FALSE) AS rich, coalesce(n IN (1, 2, 3, 4, 5, 6), FALSE) AND coalesce(b < 7000, FALSE) AS near, balance = '' OR nation IS NULL AS missing, balance <> '' AND b IS NULL AS bad FROM m)"""


@query(_CLASSED + " SELECT c_custkey, CASE WHEN rich AND NOT near THEN 'rich' WHEN near AND NOT rich THEN 'near' END AS label, CASE WHEN rich AND near THEN 'ambiguous_condition_match' WHEN rich OR near THEN 'matched_condition' WHEN bad THEN 'cast_error' WHEN missing THEN 'missing_value' ELSE 'no_matching_condition' END AS reason FROM q")
def resolve_labels(spark: SparkSession, d: str) -> DataFrame:
    return pr.classify(_rows(spark, d), CONDITIONS).select("c_custkey", "label", "reason")


@query(_CLASSED + " SELECT c_custkey, near AND NOT missing AND NOT bad AS kept FROM q")
def strict_rule(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    return r.select("c_custkey", pr.matches(CONDITIONS[1]["when"], r.columns).alias("kept"))


@query("SELECT c_custkey, NOT coalesce(lower(trim(CASE c_custkey % 5 WHEN 0 THEN ' No' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'yes' ELSE '0' END)) IN ('0', 'false', 'f', 'no', 'n', 'off'), FALSE) AS keep FROM customer")
def keep_flag(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    word = F.when(k == 0, " No").when(k == 1, "").when(k == 3, "yes").when(k == 4, "0")
    return read(spark, d, "customer").select("c_custkey", pr.keep_flag(word).alias("keep"))


# Trials


@query("WITH l AS (SELECT event_id AS row_index, user_id AS trial_id, event_type AS code FROM events), last AS (SELECT trial_id, arg_max(code, row_index) AS event_code, max(row_index) AS event_row_index FROM l GROUP BY 1) SELECT c_custkey AS trial_id, c_mktsegment AS segment, event_code, event_row_index FROM customer JOIN last ON trial_id = c_custkey")
def trial_id_join(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select(F.col("event_id").alias("row_index"), F.col("user_id").alias("trial_id"), F.col("event_type").alias("code"))
    labels = read(spark, d, "customer").select(F.col("c_custkey").alias("trial_id"), F.col("c_mktsegment").alias("segment"))
    return tr.join_on_trial_id(events, labels).select("trial_id", "segment", "event_code", "event_row_index")


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS position FROM conversations) SELECT conv_id, u.position, u.turn AS turn, a.turn AS other_turn FROM (SELECT * FROM t WHERE role = 'user') u JOIN (SELECT * FROM t WHERE role = 'assistant') a USING (conv_id, position)")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn", "role")
    out = tr.join_by_position(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id", [F.asc_nulls_last("turn")])
    return rounded(out, "conv_id", "position", "turn", "other_turn")


@query("SELECT c_custkey, coalesce(nullif(l, ''), nullif(e, ''), l, e) AS value FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_mktsegment END AS l, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS e FROM customer)")
def merged_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    label, event = F.when(k % 3 == 0, "").when(k % 3 == 2, F.col("c_mktsegment")), F.when(k % 2 == 0, F.col("c_name")).otherwise("")
    return read(spark, d, "customer").select("c_custkey", tr.merged(label, event).alias("value"))


@query(f"WITH {EPOCHS}, m AS (SELECT DISTINCT trial, feature FROM e WHERE (trial + feature) % 9 = 0) SELECT e.trial, e.feature, t_idx, CASE WHEN m.trial IS NULL THEN round(v, 6) END AS v FROM e LEFT JOIN m ON e.trial = m.trial AND e.feature = m.feature")
def feature_mask(spark: SparkSession, d: str) -> DataFrame:
    e = epochs(spark, d)
    mask = e.select("trial", "feature").distinct().withColumn("masked", (F.col("trial") + F.col("feature")) % 9 == 0)
    return rounded(ep.apply_mask(e, mask, ["trial", "feature"]), "trial", "feature", "t_idx", "v")


@query("""WITH s AS (SELECT vec_id AS recording, i - 1 AS sample, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS r(i)), a AS (SELECT vec_id AS recording, k AS trial, (k * 17 + vec_id) % 70 AS anchor_sample FROM embeddings, range(4) AS g(k))
 SELECT recording, trial, sample - anchor_sample + 3 AS t_idx, round(v, 6) AS v FROM s JOIN a USING (recording) WHERE sample BETWEEN anchor_sample - 3 AND anchor_sample + 4 AND anchor_sample - 3 >= 0 AND anchor_sample + 4 <= 63""")
def epoch_extract(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    signal = e.select(F.col("vec_id").alias("recording"), F.posexplode("embedding").alias("sample", "v")).withColumn("v", F.col("v").cast("double"))
    anchors = e.select(F.col("vec_id").alias("recording"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("trial"))
    anchors = anchors.withColumn("anchor_sample", (F.col("trial") * 17 + F.col("recording")) % 70)
    return rounded(ep.extract(signal, anchors, -3, 4), "recording", "trial", "t_idx", "v")


# Catalogs


_PATHS = "f AS (SELECT event_id, user_id AS u, '/data/sub-' || (user_id % 20)::VARCHAR || CASE WHEN user_id % 3 > 0 THEN '/ses-' || (event_id % 4)::VARCHAR ELSE '' END || '/ieeg/sub-' || (user_id % 20)::VARCHAR || CASE WHEN user_id % 3 > 0 THEN '_ses-' || (event_id % 4)::VARCHAR ELSE '' END || '_task-' || event_type || '_run-' || (event_id % 5)::VARCHAR || '_ieeg.vhdr' AS path FROM events)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    sub, ses = (F.col("user_id") % 20).cast("string"), (F.col("event_id") % 4).cast("string")
    has = F.col("user_id") % 3 > 0
    path = F.concat(
        F.lit("/data/sub-"), sub, F.when(has, F.concat(F.lit("/ses-"), ses)).otherwise(""), F.lit("/ieeg/sub-"), sub, F.when(has, F.concat(F.lit("_ses-"), ses)).otherwise(""),
        F.lit("_task-"), "event_type", F.lit("_run-"), (F.col("event_id") % 5).cast("string"), F.lit("_ieeg.vhdr"),
    )
    return e.select("event_id", F.col("user_id").alias("u"), path.alias("path"))


@query(f"WITH {_PATHS} SELECT event_id, regexp_extract(path, '_?sub-([^_/]+)_', 1) AS sub, nullif(regexp_extract(path, '_ses-([^_/]+)', 1), '') AS ses, regexp_extract(path, '_task-([^_/]+)', 1) AS task, regexp_extract(path, '_run-([^_/]+)', 1) AS run, 'ieeg' AS suffix, '.vhdr' AS extension, 'ieeg' AS datatype FROM f")
def entity_parse(spark: SparkSession, d: str) -> DataFrame:
    return ct.with_entities(_paths(spark, d)).select("event_id", "sub", "ses", "task", "run", "suffix", "extension", "datatype")


@query(f"WITH {_PATHS} SELECT event_id, parse_filename(path) AS name FROM f")
def file_name_build(spark: SparkSession, d: str) -> DataFrame:
    f = ct.with_entities(_paths(spark, d))
    return f.select("event_id", ct.build_name(F.col("entities"), F.col("suffix"), F.col("extension")).alias("name"))


@query(f"WITH {_PATHS} SELECT event_id, parse_filename(path) AS name FROM f")
def file_name_unknown_entity(spark: SparkSession, d: str) -> DataFrame:
    """An entity outside the fixed order leaves the name as it was."""
    f = ct.with_entities(_paths(spark, d))
    more = F.map_concat("entities", F.create_map(F.lit("zz"), F.col("event_id").cast("string")))
    return f.select("event_id", ct.build_name(more, F.col("suffix"), F.col("extension")).alias("name"))


@query(f"WITH {_PATHS}, s AS (SELECT (u % 20)::VARCHAR AS sub, path FROM f) SELECT sub, min(path) AS \"primary\", count(*) AS n_files FROM s GROUP BY sub")
def subject_groups(spark: SparkSession, d: str) -> DataFrame:
    return ct.subject_groups(ct.with_entities(_paths(spark, d)))


@query(f"WITH {_PATHS}, x AS (SELECT DISTINCT u % 20 AS s, u, event_id, path FROM f WHERE event_id % 5 = 0), g AS (SELECT s, count(*) AS n FROM x GROUP BY s), p AS (SELECT s, unnest(['sub', 'run'] ) AS key, unnest([(u % 20)::VARCHAR, (event_id % 5)::VARCHAR]) AS value FROM x) SELECT s::VARCHAR AS sub, key, value FROM p JOIN g USING (s) GROUP BY s, key, value, n HAVING count(*) = n")
def shared_entities(spark: SparkSession, d: str) -> DataFrame:
    f = ct.with_entities(_paths(spark, d).where("event_id % 5 = 0"))
    return ct.shared_entities(f, "sub").where("key in ('sub', 'run')")


@query(f"""WITH {_PATHS}, t AS (SELECT DISTINCT path, (u % 20)::VARCHAR AS sub, CASE WHEN u % 3 > 0 THEN (event_id % 4)::VARCHAR END AS ses, regexp_extract(path, '_task-([^_/]+)', 1) AS task, (event_id % 5)::VARCHAR AS run FROM f WHERE event_id < 400),
 k AS (SELECT DISTINCT CASE WHEN event_id % 7 > 0 THEN sub END AS sub, CASE WHEN event_id % 2 > 0 THEN ses END AS ses, task FROM (SELECT event_id, (u % 20)::VARCHAR AS sub, CASE WHEN u % 3 > 0 THEN (event_id % 4)::VARCHAR END AS ses, event_type AS task FROM f JOIN events USING (event_id) WHERE event_id < 300)),
 c AS (SELECT concat_ws('_', 'sub-' || sub, 'ses-' || ses, 'task-' || task, 'electrodes.tsv') AS path, sub, ses, task FROM k),
 m AS (SELECT t.path AS target, c.path AS candidate, coalesce((t.sub = c.sub)::INT, 0) + coalesce((t.ses = c.ses)::INT, 0) + coalesce((t.task = c.task)::INT, 0) AS score, (c.sub IS NOT NULL)::INT + (c.ses IS NOT NULL)::INT + (c.task IS NOT NULL)::INT AS spec FROM t JOIN c ON (t.sub = c.sub OR c.sub IS NULL) AND (t.ses = c.ses OR c.ses IS NULL OR t.ses IS NULL) AND (t.task = c.task OR c.task IS NULL)),
 r AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY score DESC, spec) AS r FROM m)
 SELECT target, min(candidate) AS candidate, min(score)::BIGINT AS score, count(*) > 1 AS ambiguous FROM r WHERE r = 1 GROUP BY target""")
def best_entity_match(spark: SparkSession, d: str) -> DataFrame:
    all_ = ct.with_entities(_paths(spark, d))
    targets = all_.where("event_id < 400").select("path", "sub", "ses", "task", "run", "entities").dropDuplicates(["path"])
    some = all_.where("event_id < 300").select(F.when(F.col("event_id") % 7 > 0, F.col("sub")).alias("sub"), F.when(F.col("event_id") % 2 > 0, F.col("ses")).alias("ses"), "task").distinct()
    path = F.concat_ws("_", *(F.concat(F.lit(f"{k}-"), F.col(k)) for k in ("sub", "ses", "task")), F.lit("electrodes.tsv"))
    return rounded(ct.best_match(targets, ct.with_entities(some.select(path.alias("path")))))


@query(f"WITH {_PATHS}, w AS (SELECT DISTINCT path FROM f WHERE event_id < 600), g AS (SELECT DISTINCT path FROM f WHERE event_id >= 300 AND event_id < 900) SELECT path FROM w WHERE path NOT IN (SELECT path FROM g)")
def skip_existing(spark: SparkSession, d: str) -> DataFrame:
    f = _paths(spark, d)
    return ct.still_to_do(f.where("event_id < 600").select("path").distinct(), f.where("event_id >= 300 and event_id < 900"))


@query("SELECT c_mktsegment AS segment, c_nationkey::BIGINT AS nation, min(c_name) AS \"primary\", count(*) AS n_files FROM customer GROUP BY ALL")
def compatible_groups(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_name").alias("path"))
    return gr.compatible_groups(c, ["segment", "nation"])


# Channels and regions


@query("SELECT c_custkey, 'Customer#' AS prefix, substr(c_name, 10)::BIGINT AS number FROM customer")
def channel_parse(spark: SparkSession, d: str) -> DataFrame:
    prefix, number = gr.channel_parts(F.concat(F.lit(" "), "c_name"))
    return rounded(read(spark, d, "customer").select("c_custkey", prefix.alias("prefix"), number.alias("number")))


@query("WITH c AS (SELECT chr((65 + s_suppkey % 6)::INT) AS prefix, (s_suppkey * 7 % 31)::BIGINT AS number FROM supplier GROUP BY ALL) SELECT a.prefix || a.number AS first, b.prefix || b.number AS second, a.prefix || a.number || '-' || b.prefix || b.number AS label FROM c a JOIN c b ON a.prefix = b.prefix AND b.number = a.number + 1")
def bipolar_montage(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.char((65 + F.col("s_suppkey") % 6).cast("int")), (F.col("s_suppkey") * 7 % 31).cast("string"))
    return gr.bipolar_pairs(read(spark, d, "supplier").select(name.alias("name")).distinct()).select("first", "second", "label")


_REGION = "atlas AS (SELECT 'N' || n_nationkey AS name, CASE WHEN n_nationkey % 6 = 0 THEN 'N/A' ELSE r_name END AS region FROM nation JOIN region ON n_regionkey = r_regionkey), ch AS (SELECT c_custkey, c_custkey % 40 AS subject, ' n' || c_nationkey || ' ' AS channel, c_acctbal AS v FROM customer)"


def _channels(spark: SparkSession, d: str) -> DataFrame:
    atlas = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    atlas = atlas.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.when(F.col("n_nationkey") % 6 == 0, "N/A").otherwise(F.col("r_name")).alias("region"))
    c = read(spark, d, "customer")
    c = c.select("c_custkey", (F.col("c_custkey") % 40).alias("subject"), F.concat(F.lit(" n"), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("channel"), F.col("c_acctbal").alias("v"))
    return gr.lookup_regions(c, atlas)


@query(f"WITH {_REGION} SELECT c_custkey, region, FALSE AS conflict FROM ch JOIN atlas ON lower(trim(channel)) = lower(name) WHERE region <> 'N/A'")
def roi_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _channels(spark, d).select("c_custkey", "region", "conflict")


@query(f"WITH {_REGION} SELECT region, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, count(v) AS n_obs, round(avg(v) / (stddev_samp(v) / sqrt(count(v))), 6) AS t, (count(v) - 1)::DOUBLE AS df FROM ch JOIN atlas ON lower(trim(channel)) = lower(name) WHERE region <> 'N/A' GROUP BY region")
def roi_group_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.region_statistics(_channels(spark, d), []))


@query(f"WITH {_REGION}, s AS (SELECT region, count(DISTINCT (subject, channel)) AS n_channels, count(DISTINCT subject) AS n_subjects FROM ch JOIN atlas ON lower(trim(channel)) = lower(name) WHERE region <> 'N/A' AND c_custkey % 4 = 0 GROUP BY region) SELECT region, n_channels, n_subjects, CASE WHEN n_channels < 36 THEN 'insufficient_channels:' || n_channels || '<36' WHEN n_subjects < 12 THEN 'insufficient_subjects:' || n_subjects || '<12' END AS excluded FROM s")
def roi_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return gr.region_thresholds(_channels(spark, d).where("c_custkey % 4 = 0"), 36, 12)


@query("SELECT DISTINCT c_nationkey::BIGINT AS channel FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def missing_channels(spark: SparkSession, d: str) -> DataFrame:
    wanted = read(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("channel"))
    present = read(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").cast("long").alias("channel"))
    return gr.missing_channels(wanted, present, ["channel"])


@query("SELECT c_custkey AS channel, " + ", ".join(f"round(count(event_id) FILTER (event_type = '{t}') / 2.5::DOUBLE, 6) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey")
def event_rates_pivot(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select(F.col("user_id").alias("channel"), "event_type")
    channels = read(spark, d, "customer").select(F.col("c_custkey").alias("channel"))
    return gr.event_rates(events, channels, ["click", "error", "purchase", "signup", "view"], duration_s=2.5)


@query("""SELECT event_id, CASE WHEN f < 1 THEN 'Infra slow' WHEN f < 3.5 THEN 'Delta' WHEN f < 7.4 THEN 'Theta' WHEN f < 12.4 THEN 'Alpha' WHEN f < 24 THEN 'Beta'
 WHEN f < 80 THEN 'Gamma' WHEN f < 250 THEN 'Ripple' WHEN f < 500 THEN 'Fast Ripple' ELSE 'Very Fast Osc' END AS band FROM (SELECT event_id, value * 6 AS f FROM events) WHERE f >= 0
 UNION ALL SELECT event_id, NULL FROM events WHERE value < 0 OR value IS NULL""")
def band_classify(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", gr.classify_band(F.col("value") * 6).alias("band"))


# Scalars


@query("SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9_]', '_', 'g') AS field, 'f_' || p_partkey || '_' || regexp_replace(p_brand, '[^a-zA-Z0-9_]', '_', 'g') AS struct_name FROM part")
def name_sanitise(spark: SparkSession, d: str) -> DataFrame:
    odd = F.concat(F.lit("_"), F.col("p_partkey").cast("string"), F.lit("/"), "p_brand")
    return read(spark, d, "part").select("p_partkey", tx.field_name(F.col("p_name")).alias("field"), tx.struct_name(odd).alias("struct_name"))


@query("SELECT p_partkey, CASE WHEN x >= 0 THEN floor(x + 0.5) ELSE ceil(x - 0.5) END AS away, round_even(x, 0) AS even FROM (SELECT p_partkey, (p_size - 25)::DOUBLE / 2 AS x FROM part)")
def rounding(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("p_size") - 25) / F.lit(2.0)
    return read(spark, d, "part").select("p_partkey", half_away(x).alias("away"), half_even(x).alias("even"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN p_size::VARCHAR ELSE p_type END AS value FROM part")
def clean_value(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.lit(" N/A ")).when(k == 1, F.concat(F.lit("00"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit(" "), "p_type"))
    return read(spark, d, "part").select("p_partkey", tx.row_code(raw).alias("value"))


@query("SELECT event_id, '{\"code\":\"' || event_type || '\",\"user\":\"' || user_id || '\"}' AS inputs FROM events")
def stable_json(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("code"), F.col("event_type"))
    return read(spark, d, "events").select("event_id", tx.stable_json(m).alias("inputs"))


@query("SELECT c_custkey, round_even(4 * pow(2, (c_custkey % 58)::DOUBLE / 10) * (1 + c_custkey % 4), 0) / (1 + c_custkey % 4) AS frequency FROM customer")
def freq_grid(spark: SparkSession, d: str) -> DataFrame:
    """A log-spaced frequency of each customer, snapped to those that its epoch, of one to four seconds, resolves."""
    k = F.col("c_custkey")
    seconds = (1 + k % 4).cast("double")
    return read(spark, d, "customer").select("c_custkey", (half_even(4.0 * F.pow(F.lit(2.0), (k % 58) / F.lit(10.0)) * seconds) / seconds).alias("frequency"))


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 50 WHEN 1 THEN 100 ELSE 250 END AS fs FROM supplier)
 SELECT s_suppkey, i::BIGINT AS i, i::DOUBLE / fs AS time_s FROM s, range(-50, 126) AS g(i) WHERE i BETWEEN -fs // 5 AND fs // 2""")
def time_axis(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's axis from a fifth of a second before to half a second after, at its rate."""
    first = {50: 10, 100: 20, 250: 50}
    fs = F.when(F.col("s_suppkey") % 3 == 0, 50).when(F.col("s_suppkey") % 3 == 1, 100).otherwise(250)
    axis = F.when(fs == 50, ep.time_axis(50.0, -0.2, 0.5)).when(fs == 100, ep.time_axis(100.0, -0.2, 0.5)).otherwise(ep.time_axis(250.0, -0.2, 0.5))
    rows = read(spark, d, "supplier").select("s_suppkey", fs.alias("fs"), F.posexplode(axis).alias("i", "time_s"))
    before = F.when(F.col("fs") == 50, first[50]).when(F.col("fs") == 100, first[100]).otherwise(first[250])
    return rows.select("s_suppkey", (F.col("i") - before).cast("long").alias("i"), "time_s")


# Further trials, windows and names


@query(f"WITH {_PATHS} SELECT event_id FROM f WHERE (u % 20)::VARCHAR IN ('1', '2', '3') AND u % 3 = 0 AND event_id % 5 = 2")
def entity_filter(spark: SparkSession, d: str) -> DataFrame:
    return ct.matching(ct.with_entities(_paths(spark, d)), sub=["1", "2", 3], ses=None, run=2).select("event_id")


@query("SELECT s_name AS name FROM supplier WHERE regexp_matches(s_name, '[13579]$') AND s_name <> 'Supplier#000000001'")
def channel_select(spark: SparkSession, d: str) -> DataFrame:
    channels = read(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return gr.select_channels(channels, ["Supplier#\\d*[13579]"], ["Supplier#000000001"])


@query(f"WITH {EPOCHS} SELECT trial, feature, t_idx FROM e WHERE time_s > -0.1 AND time_s < 0.3")
def time_window_strict(spark: SparkSession, d: str) -> DataFrame:
    return ep.time_window(epochs(spark, d), -0.1, 0.3, "strict").select("trial", "feature", "t_idx")


_ORDERS = "o AS (SELECT o_orderkey AS trial, o_orderkey % 7 > 0 AS keep, o_orderstatus AS label, CASE WHEN o_orderkey % 11 = 0 THEN 'x' WHEN o_orderkey % 13 = 0 THEN 'Infinity' ELSE o_totalprice::VARCHAR END AS predictor FROM orders)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = F.when(k % 11 == 0, "x").when(k % 13 == 0, "Infinity").otherwise(F.col("o_totalprice").cast("string"))
    return read(spark, d, "orders").select(k.alias("trial"), (k % 7 > 0).alias("keep"), F.col("o_orderstatus").alias("label"), x.alias("predictor"), F.lit(None).cast("string").alias("exclusion_reason"))


@query(f"WITH {_ORDERS} SELECT trial, keep AND label IN ('O', 'F') AND trial % 11 > 0 AND trial % 13 > 0 AS keep, CASE WHEN NOT keep THEN NULL WHEN label NOT IN ('O', 'F') THEN 'unsupported_label' WHEN trial % 11 = 0 OR trial % 13 = 0 THEN 'invalid_predictor_value' END AS exclusion_reason FROM o")
def normalise_trials(spark: SparkSession, d: str) -> DataFrame:
    return tr.normalise_trials(_orders(spark, d), ["O", "F"], "predictor").select("trial", "keep", "exclusion_reason")


@query(f"WITH {_ORDERS} SELECT trial, keep AND label = 'F' AS keep, CASE WHEN keep AND label <> 'F' THEN 'not_final' END AS exclusion_reason FROM o")
def trial_metadata_rule(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    rule = pr.matches({"column": "label", "op": "==", "value": "f"}, o.columns)
    return tr.keep_only(o, rule, "not_final").select("trial", "keep", "exclusion_reason")


@query("SELECT o_orderkey AS trial, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 5 END NULLS LAST, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 10 END NULLS LAST, o_orderkey) AS place FROM orders")
def trial_order(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select("o_custkey", k.alias("trial"), F.when(k % 3 > 0, k % 5).alias("order"), F.when(k % 4 > 0, k % 10).alias("onset"))
    return rounded(tr.in_order(o, "o_custkey", row="trial"), "trial", "place")


@query()
def ordered_match(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d)
    anchors = a.where("code in ('click', 'view')").select("recording", F.col("event_id").alias("anchor"), "onset", "code")
    rows = a.where("code in ('click', 'view')").select("recording", F.col("event_id").alias("row"), F.col("event_id").alias("place"), F.when(F.col("event_id") % 2 > 0, F.when(F.col("value") < 100, F.col("code")).otherwise("n/a")).alias("code"), F.when(F.col("event_id") % 5 > 0, F.lit("x")).alias("label"))
    return tr.match_in_order(anchors, rows)


@query(f"WITH {ANNOTATIONS}, x AS (SELECT event_id, recording, code, row_number() OVER (PARTITION BY recording, code ORDER BY event_id) AS i FROM a), y AS (SELECT recording, code, k AS duration, row_number() OVER (PARTITION BY recording, code ORDER BY event_id) AS i FROM a WHERE event_id % 2 = 0) SELECT event_id, duration FROM x LEFT JOIN y ON x.recording = y.recording AND x.code = y.code AND x.i = y.i")
def duration_pairing(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d)
    durations = a.where("event_id % 2 = 0").select("recording", "code", "event_id", F.col("k").alias("duration"))
    return tr.pair_durations(a, durations, ["recording", "code"], "event_id").select("event_id", "duration")


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'missing_response_time' WHEN c_acctbal <= 0 THEN 'nonpositive_response_time' WHEN c_acctbal * 0.001 > 5 THEN 'response_after_epoch_end' END AS reason FROM customer")
def response_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "soon").otherwise(F.col("c_acctbal").cast("string")).alias("rt"))
    return c.select("c_custkey", tr.skip_reason(tr.response_time(c, "rt", "ms"), 5.0, False).alias("reason"))


@query(f"WITH {EPOCHS} SELECT trial, feature // 2 AS region, t_idx, CASE WHEN count(v) = count(*) THEN round(avg(v), 6) END AS v FROM e GROUP BY ALL")
def roi_epoch_means(spark: SparkSession, d: str) -> DataFrame:
    e = epochs(spark, d).withColumn("region", F.expr("feature DIV 2"))
    return rounded(ep.region_means(e, ["trial", "region", "t_idx"]))


@query(f"WITH {_REGION}, w AS (SELECT 'R' || (c_custkey % 3) AS roi, c_custkey FROM customer WHERE c_custkey % 2 = 0) SELECT w.roi, count(*) AS n, round(avg(v), 6) AS mean FROM w JOIN ch USING (c_custkey) WHERE c_custkey % 5 > 0 GROUP BY roi")
def manual_roi_records(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    inputs = c.where("c_custkey % 5 > 0").select(F.lit("s").alias("subject"), F.col("c_custkey").cast("string").alias("channel"), F.lit(0).alias("t_idx"), "c_acctbal")
    wanted = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("R"), (F.col("c_custkey") % 3).cast("string")).alias("roi"), F.lit("s").alias("subject"), F.col("c_custkey").cast("string").alias("channel"))
    records = pipelines.contributions(inputs, wanted, "c_acctbal")
    return rounded(records.groupBy("roi").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")))


@query(f"WITH {ANNOTATIONS}, c AS (SELECT recording, onset, row_number() OVER (PARTITION BY recording ORDER BY onset, event_id) - 1 AS k, count(*) OVER (PARTITION BY recording) AS n FROM a WHERE code = 'error') SELECT recording, k AS trial, onset::DOUBLE AS onset FROM c WHERE n >= 12 AND k < 12 UNION ALL SELECT recording, t::BIGINT, t::DOUBLE FROM (SELECT DISTINCT recording FROM c WHERE n < 12), range(12) AS g(t)")
def anchors_for_maps(spark: SparkSession, d: str) -> DataFrame:
    return gr.anchors_or_numbers(annotations(spark, d).where("code = 'error'"), 12, "recording")


@query(f"WITH {EPOCHS}, t AS (SELECT condition, trial, any_value(x) AS x, avg(v) AS y FROM e GROUP BY ALL) SELECT condition, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM t GROUP BY condition")
def scatter_line(spark: SparkSession, d: str) -> DataFrame:
    t = epochs(spark, d).groupBy("condition", "trial").agg(F.any_value("x").alias("x"), F.avg("v").alias("y"))
    return rounded(t.groupBy("condition").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")))


@query(f"WITH {EPOCHS}, m AS (SELECT feature, t_idx, avg(v) AS m FROM e GROUP BY ALL) SELECT feature, round(quantile_cont(abs(m - 0.01), 0.99), 6) AS top FROM m GROUP BY feature")
def colour_limits(spark: SparkSession, d: str) -> DataFrame:
    m = epochs(spark, d).groupBy("feature", "t_idx").agg(F.avg("v").alias("m"))
    return rounded(m.groupBy("feature").agg(F.percentile(F.abs(F.col("m") - 0.01), 0.99).alias("top")))


@query(f"WITH {_PATHS} SELECT event_id, 'sub-' || (u % 20)::VARCHAR || CASE WHEN u % 3 > 0 THEN '_ses-' || (event_id % 4)::VARCHAR ELSE '' END || '_task-' || regexp_extract(path, '_task-([^_/]+)', 1) || '_desc-clean_epo.tsv' AS name FROM f")
def entity_modify(spark: SparkSession, d: str) -> DataFrame:
    f = ct.with_entities(_paths(spark, d))
    changed = ct.modify_entities(F.col("entities"), {"run": None, "desc": "clean"})
    return f.select("event_id", ct.build_name(changed, F.lit("epo"), F.lit(".tsv")).alias("name"))


@query(f"WITH {_PATHS} SELECT event_id, '/out/sub-' || (u % 20)::VARCHAR || CASE WHEN u % 3 > 0 THEN '/ses-' || (event_id % 4)::VARCHAR ELSE '' END || '/ieeg/' || replace(parse_filename(path), '_ieeg.vhdr', '_stats.parquet') AS path FROM f")
def result_paths(spark: SparkSession, d: str) -> DataFrame:
    f = ct.with_entities(_paths(spark, d))
    return f.select("event_id", sinks.result_path("/out", F.col("entities"), "ieeg", "stats", ".parquet").alias("path"))


@query("SELECT c_custkey, c_custkey::VARCHAR AS subject, nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, '') AS value, c_custkey % 4 IN (0, 1, 2) AS no_region FROM customer")
def entity_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    label = F.when(k % 4 == 0, "N/A").when(k % 4 == 1, "Not available").when(k % 4 == 3, "Insula")
    return read(spark, d, "customer").select(
        "c_custkey", ct.normal_subject(F.concat(F.lit(" SUB-"), k.cast("string"))).alias("subject"), ct.normal_value(F.when(k % 2 == 0, F.concat(F.lit("ses-"), "c_mktsegment")).otherwise("")).alias("value"), gr.no_region(label).alias("no_region")
    )


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Response' WHEN event_id % 4 = 1 THEN 'Comment' ELSE 'Stimulus' END AS kind FROM events")
def event_type_fallback(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id") % 4
    kind, trial_type = F.when(i == 0, "Response").when(i == 1, "odd"), F.when(i == 1, "Comment").when(i == 2, "click")
    return read(spark, d, "events").select("event_id", tx.event_type(kind, trial_type).alias("kind"))


@query("SELECT vec_id, list_aggregate(list_transform(range(1, 65, 8), lambda i: round(embedding[i]::DOUBLE, 6)), 'sum') AS s, round(list_aggregate(list_transform(range(1, 65), lambda i: pow(embedding[i]::DOUBLE - list_avg(embedding::DOUBLE[]), 2)), 'sum'), 4) AS q FROM embeddings".replace("list_aggregate(list_transform(range(1, 65, 8), lambda i: round(embedding[i]::DOUBLE, 6)), 'sum') AS s", "round(list_aggregate(list_transform(range(1, 65, 8), lambda i: embedding[i]::DOUBLE), 'sum'), 6) AS s"))
def decimate_demean(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return read(spark, d, "embeddings").select("vec_id", F.round(total(ep.decimate(x, 8)), 6).alias("s"), F.round(total(F.transform(ep.demean(x), lambda v: v * v)), 4).alias("q"))


@query(f"WITH {EPOCHS} SELECT trial, feature, t_idx, round(v + feature * 0.5, 6) AS power FROM e")
def power_mode_raw(spark: SparkSession, d: str) -> DataFrame:
    e = epochs(spark, d).withColumn("baseline_db", F.col("feature") * 0.5)
    return rounded(ep.power_mode(e, "raw", stored_corrected=True), "trial", "feature", "t_idx", "power")


@query("SELECT o_orderkey, run::BIGINT AS run_idx FROM (SELECT o_orderkey, 0 AS run FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 3 = 1)")
def union_runs(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.lit(1000.0).alias("fs"))
    return rounded(ep.union_runs([o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 = 1")]), "o_orderkey", "run_idx")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def windowed_rates(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return rounded(rates.windowed_rates(e, "1 day")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'Response' ELSE 'Stimulus' END || '/S ' || (event_id % 12)::VARCHAR ELSE CASE WHEN event_id % 2 = 0 THEN 'Response' ELSE 'Stimulus' END || '/' || CASE WHEN event_id % 3 = 1 THEN event_type ELSE 'n/a' END END AS annotation FROM events")
def table_annotations(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    code = F.when(i % 3 == 0, F.lpad((i % 12).cast("string"), 4, "0")).otherwise("n/a")
    kind, trial_type = F.when(i % 2 == 0, "Response"), F.when(i % 3 == 1, F.col("event_type"))
    return read(spark, d, "events").select("event_id", tx.table_annotation(kind, trial_type, F.lit(" none "), code).alias("annotation"))


@query("SELECT label::BIGINT AS label, count(DISTINCT hash) AS axes FROM (SELECT label, sha1(array_to_string(list_transform(range(0, 4 + label % 3), lambda i: i::VARCHAR), ',')) AS hash FROM embeddings) GROUP BY label")
def axis_identity(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), tx.axis_hash(F.sequence(F.lit(0), 3 + F.col("label") % 3)).alias("hash"))
    return e.groupBy("label").agg(F.countDistinct("hash").alias("axes"))


@query(f"WITH {_ORDERS} SELECT trial, keep AND label <> 'P' AS keep, CASE WHEN keep AND label = 'P' THEN 'pending' END AS exclusion_reason, keep AND trial % 2 > 0 AS late FROM o")
def deferred_rules(spark: SparkSession, d: str) -> DataFrame:
    o = tr.defer(_orders(spark, d), F.col("label") != "P", "pending", "after_epoch_trial_rejection")
    o = tr.defer(o, F.col("trial") % 2 == 0, "odd", "before_activity_zscore")
    out = tr.apply_deferred(o, "after_epoch_trial_rejection")
    late = F.exists("deferred", lambda x: x["phase"] == "before_activity_zscore")
    return out.select("trial", "keep", "exclusion_reason", late.alias("late"))


@query("SELECT c.class, count(event_id) AS n, round(count(event_id) / 60.0::DOUBLE, 6) AS rate FROM (SELECT unnest(['click', 'view', 'spike']) AS class) c LEFT JOIN events ON event_type = class GROUP BY class UNION ALL SELECT 'total', count(*), round(count(*) / 60.0::DOUBLE, 6) FROM events")
def total_event_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.total_rates(read(spark, d, "events"), ["click", "view", "spike"], 60.0))


@query("WITH l AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, c_nationkey FROM customer), e AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, s_nationkey FROM supplier) SELECT c_custkey, s_suppkey FROM l JOIN e ON l.k = e.k AND c_nationkey = s_nationkey")
def row_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Labels and events without ids are joined by place."""
    labels = read(spark, d, "customer").select(F.col("c_nationkey").alias("recording"), F.col("c_custkey").alias("row_index"), "c_custkey")
    events = read(spark, d, "supplier").select(F.col("s_nationkey").alias("recording"), F.col("s_suppkey").alias("row_index"), "s_suppkey")
    rows, how = tr.build_rows(events, labels, {"choice"})
    assert how == "position"
    return rows.select("c_custkey", F.col("other_s_suppkey").alias("s_suppkey"))
