"""Queries of atlas lookup, event files, annotations, detections and pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as ct
from ..operators import records as rc
from . import pipelines
from .domain import _PATHS, _paths
from .tables import EPOCHS, epochs, read, rounded

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ATLAS = """ch AS (SELECT DISTINCT c_custkey % 40 AS item, ' n' || c_nationkey || ' ' AS channel FROM customer), src AS (SELECT DISTINCT c_custkey % 40 AS item, c_custkey % 2 AS file FROM customer),
 el AS (SELECT f.file, n_nationkey AS row_index, 'N' || n_nationkey AS name, CASE WHEN n_nationkey % 6 = 0 THEN 'N/A' WHEN n_nationkey % 4 = f.file THEN NULL ELSE r_name END AS region FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES (0), (1)) f(file))"""


def _atlas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = read(spark, d, "customer")
    item = (F.col("c_custkey") % 40).alias("item")
    channels = c.select(item, F.concat(F.lit(" n"), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("channel")).distinct()
    sources = c.select(item, (F.col("c_custkey") % 2).cast("int").alias("file")).distinct().withColumn("place", F.col("file"))
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("file", F.explode(F.array(F.lit(0), F.lit(1))))
    region = F.when(F.col("n_nationkey") % 6 == 0, "N/A").when(F.col("n_nationkey") % 4 != F.col("file"), F.col("r_name"))
    table = n.select("file", F.col("n_nationkey").alias("row_index"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("Name"), region.alias("Atlas1"))
    return channels, sources, rc.atlas_rows(table, "atlas1", ("file", "row_index"))


@query(f"WITH {_ATLAS} SELECT DISTINCT item, channel, region FROM ch JOIN src USING (item) JOIN el ON src.file = el.file AND lower(trim(channel)) = lower(name) WHERE region IS NOT NULL AND region <> 'N/A'")
def atlas_regions(spark: SparkSession, d: str) -> DataFrame:
    return rc.assign_regions(*_atlas(spark, d))


@query(f"WITH {_ATLAS}, w AS (SELECT item, channel, CASE WHEN src.file = 1 AND row_index % 3 = 0 THEN 'other' ELSE region END AS region, row_number() OVER (PARTITION BY item, channel ORDER BY src.file DESC) AS r FROM ch JOIN src USING (item) JOIN el ON src.file = el.file AND lower(trim(channel)) = lower(name) WHERE region IS NOT NULL AND region <> 'N/A') SELECT item, channel, region FROM w WHERE r = 1")
def atlas_regions_last(spark: SparkSession, d: str) -> DataFrame:
    """The second table names some regions otherwise; it wins where it has the channel."""
    channels, sources, electrodes = _atlas(spark, d)
    other = (F.col("file") == 1) & (F.col("row_index") % 3 == 0) & F.col("region").isNotNull() & (F.col("region") != "N/A")
    return rc.last_regions(channels, sources, electrodes.withColumn("region", F.when(other, "other").otherwise(F.col("region"))))


@query("SELECT regexp_replace(p_brand, '[^a-zA-Z0-9_]', '_', 'g') AS field, count(*) AS n FROM part GROUP BY 1")
def region_field_names(spark: SparkSession, d: str) -> DataFrame:
    return rc.region_fields(read(spark, d, "part"), "p_brand").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE replace(p_brand, '#', ' ') END, '[^a-zA-Z0-9_]', '_', 'g') AS field, count(*) AS n FROM part GROUP BY 1")
def region_field_merge(spark: SparkSession, d: str) -> DataFrame:
    brand = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit(" ")))
    return rc.region_fields(read(spark, d, "part").withColumn("region", brand), clash="merge").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


_EVENTS_FILE = "'sub-' || regexp_extract(path, '_?sub-([^_/]+)_', 1) || '_task-' || regexp_extract(path, '_task-([^_/]+)', 1) || '_run-' || regexp_extract(path, '_run-([^_/]+)', 1) || '_events.tsv'"


@query(f"WITH {_PATHS} SELECT DISTINCT path AS recording, CASE WHEN path NOT LIKE '%task-error%' THEN {_EVENTS_FILE} END AS events_file FROM f")
def events_file_match(spark: SparkSession, d: str) -> DataFrame:
    """Events tables know no session; recordings of errors have a table of channels only."""
    recordings = ct.with_entities(_paths(spark, d).select("path").distinct())
    name = F.concat(*(x for k in ("sub", "task", "run") for x in (F.lit(f"{k}-"), F.col(k), F.lit("_"))), F.when(F.col("task") == "error", "channels").otherwise("events"), F.lit(".tsv"))
    return rc.events_files(recordings, ct.with_entities(recordings.select(name.alias("path")).distinct()))


@query(f"WITH {_PATHS} SELECT DISTINCT path FROM f UNION SELECT DISTINCT {_EVENTS_FILE} FROM f")
def secondary_union(spark: SparkSession, d: str) -> DataFrame:
    f = ct.with_entities(_paths(spark, d))
    name = F.concat(*(x for k in ("sub", "task", "run") for x in (F.lit(f"{k}-"), F.col(k), F.lit("_"))), F.lit("events.tsv"))
    return rc.secondary_files([f.select("path"), f.select(name.alias("path")), f.select("path")])


@query(f"WITH {_PATHS} SELECT event_id, regexp_replace(parse_filename(path), '^sub-[^_]+', 'sub-group') AS name FROM f")
def group_file_name(spark: SparkSession, d: str) -> DataFrame:
    f = ct.with_entities(_paths(spark, d))
    return f.select("event_id", ct.build_name(rc.group_entities(F.col("entities")), F.col("suffix"), F.col("extension")).alias("name"))


@query("""SELECT event_id, event_id / 250.0 AS onset, coalesce(k, 0) / 250.0 AS duration, CASE WHEN event_id % 5 = 1 THEN 'a/b' WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 4 = 2 THEN 'Response/n/a' WHEN event_id % 4 = 3 THEN 'Comment/n/a' ELSE 'Stimulus/n/a' END
 WHEN event_id % 4 = 2 THEN 'Response/R ' || event_type WHEN event_id % 4 = 3 THEN 'Comment/' || event_type ELSE 'Stimulus/S ' || event_type END AS text FROM (SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)""")
def envelope_annotations(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(i % 4 == 1, "Stimulus").when(i % 4 == 2, "Response").when(i % 4 == 3, " Comment ")
    what = F.when(i % 5 == 0, "").when(i % 5 == 1, " a/b").otherwise(F.col("event_type"))
    e = read(spark, d, "events").select("event_id", i.alias("onset"), F.get_json_object("props", "$.k").cast("double").alias("duration"), kind.alias("type"), what.alias("description"))
    return rounded(rc.envelope_annotations(e, 250), "event_id", "onset", "duration", "text")


@query("SELECT round(event_id::DOUBLE, 6) AS onset, 0::DOUBLE AS duration, user_id::VARCHAR AS channel, event_type, round(coalesce(value, 0), 6) AS peak_frequency, event_id AS sample_index, 0::BIGINT AS frequency_index, 0::DOUBLE AS detection_strength, '#808080' AS color FROM events")
def detection_table(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return rounded(rc.detection_table(e.select(F.col("event_id").cast("double").alias("onset"), F.col("user_id").cast("string").alias("channel"), "event_type", F.col("value").alias("peak_frequency"), F.col("event_id").alias("sample_index"))))


_COUNTED = {"infra_slow": (0, 1), "delta": (1, 3.5), "theta": (3.5, 7.4), "alpha": (7.4, 12.4), "beta": (12.4, 24), "gamma": (24, 80), "ripple": (80, 250), "fast_ripple": (250, 500), "very_fast_osc": (500, 1e300)}


@query("SELECT c_custkey AS channel, " + ", ".join(f"count(event_id) FILTER (event_type <> 'error' AND value * 6 >= {a} AND value * 6 < {b}) AS {n}" for n, (a, b) in _COUNTED.items()) + ", count(event_id) FILTER (event_type = 'error') AS n_spikes FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey")
def band_counts(spark: SparkSession, d: str) -> DataFrame:
    """Errors in the role of spikes."""
    kind = F.when(F.col("event_type") == "error", "Spike").otherwise(F.col("event_type"))
    found = read(spark, d, "events").select(F.col("user_id").alias("channel"), kind.alias("event_type"), (F.col("value") * 6).alias("peak_frequency"))
    return rc.band_counts(found, read(spark, d, "customer").select(F.col("c_custkey").alias("channel")))


@query("SELECT vec_id AS trial, i - 1 AS pos, round(embedding[i]::DOUBLE, 6) AS x, round(embedding[65 - i]::DOUBLE, 6) AS y FROM embeddings, range(1, 65) AS r(i) WHERE vec_id % 5 > 0")
def scatter_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth record has one value too few on a side, or none."""
    i = F.col("vec_id")
    y = F.when(i % 10 == 0, F.slice(F.reverse("embedding"), 1, 63)).when(i % 5 > 0, F.reverse("embedding"))
    return rounded(rc.scatter_pairs(read(spark, d, "embeddings").select(i.alias("trial"), F.col("embedding").alias("x"), y.alias("y")), ["trial"]))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 9 > 0")
def valued_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth row is missing throughout."""
    bad = F.transform("embedding", lambda v: F.when(v > 0, float("nan")).otherwise(F.lit(None)))
    rows = read(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 9 > 0, F.col("embedding").cast("array<double>")).otherwise(bad).alias("values"))
    return rc.valued_rows(rows).select("vec_id")


@query(f"WITH {EPOCHS} SELECT trial, t_idx, (feature // 4)::BIGINT AS channel, (feature % 4)::BIGINT AS f_idx FROM e")
def flat_features(spark: SparkSession, d: str) -> DataFrame:
    e = epochs(spark, d)
    channel, f = rc.channel_and_frequency(F.col("feature"), 4)
    again = e.select("trial", "t_idx", rc.flat_feature(channel, f, 4).alias("feature"))
    channel, f = rc.channel_and_frequency(F.col("feature"), 4)
    return rounded(again.select("trial", "t_idx", channel.alias("channel"), f.alias("f_idx")))


# Many subjects in one plan


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    """Epochs of five subjects, whose trials are numbered alike."""
    return epochs(spark, d).withColumns({"subject": F.col("label") % 5, "trial": F.expr("trial DIV 5")})


_CELL = "subject, feature, t_idx"


@query(f"WITH {EPOCHS} SELECT label % 5 AS subject, condition, feature, t_idx, round(avg(v), 6) AS mean, count(v) AS n_obs, round(avg(v) / (stddev_samp(v) / sqrt(count(v))), 6) AS t FROM e GROUP BY ALL")
def against_zero_subjects(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pipelines.against_zero(_subjects(spark, d), by=["subject"]), "subject", "condition", "feature", "t_idx", "mean", "n_obs", "t")


@query(f"""WITH {EPOCHS}, c AS (SELECT label % 5 AS subject, feature, t_idx, avg(v) FILTER (condition = 'A') AS a, avg(v) FILTER (condition = 'B') AS b, var_samp(v) FILTER (condition = 'A') / count(v) FILTER (condition = 'A') AS qa, var_samp(v) FILTER (condition = 'B') / count(v) FILTER (condition = 'B') AS qb FROM e GROUP BY ALL)
 SELECT {_CELL}, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round((a - b) / sqrt(qa + qb), 6) AS t FROM c""")
def condition_test_subjects(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pipelines.condition_test(_subjects(spark, d), by=["subject"]), "subject", "feature", "t_idx", "mean_a", "mean_b", "t")


@query(f"""WITH {EPOCHS}, u AS (SELECT label % 5 AS subject, vec_id % 11 AS unit, feature, t_idx, avg(v) FILTER (condition = 'A') - avg(v) FILTER (condition = 'B') AS v FROM (SELECT *, trial AS vec_id FROM e) GROUP BY ALL)
 SELECT {_CELL}, round(avg(v), 6) AS mean, count(v) AS n_obs, round(avg(v) / (stddev_samp(v) / sqrt(count(v))), 6) AS t FROM u GROUP BY ALL""")
def paired_test_subjects(spark: SparkSession, d: str) -> DataFrame:
    rows = epochs(spark, d).withColumns({"subject": F.col("label") % 5, "unit": F.col("trial") % 11})
    return rounded(pipelines.condition_test(rows, by=["subject"], unit="unit"), "subject", "feature", "t_idx", "mean", "n_obs", "t")
