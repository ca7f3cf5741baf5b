"""Entities that files share: by hand, and what the plan does with a path."""

from pyspark.sql import functions as F

from voltaic.operators import catalog


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shared_entities_of_odd_files(spark):
    names = [
        "sub-1_ses-a_task-x_run-1_desc-p_ieeg.vhdr", "sub-1_ses-a_task-y_run-1_run-2_desc-p_ieeg.vhdr", "sub-1_ses-a_task-y_run-1_desc-p_ieeg.vhdr",
        "subject-2_sub-3_task-x_acq-_-k_ieeg.vhdr", "sub-2_task-x_acq-_-k_ieeg.vhdr", "sub-2_task-x_acq-_-k_ieeg.vhdr", "sub-_task-x_ieeg.vhdr", "task-x_ieeg.vhdr", "ieeg.vhdr", "", None,
    ]
    files = catalog.with_entities(spark.createDataFrame([(n and f"/d/{n}",) for n in names], "path string"))
    got = sorted(tuple(r) for r in catalog.shared_entities(files, "sub").collect())
    assert got == [("1", "run", "1"), ("1", "ses", "a"), ("1", "sub", "1"), ("2", "", "k"), ("2", "acq", ""), ("2", "sub", "2"), ("2", "task", "x")]
    assert catalog.shared_entities(files).collect() == [] and catalog.shared_entities(files.limit(0)).collect() == []
    assert sorted(tuple(r) for r in catalog.shared_entities(files.where("sub is null and path like '%task%'")).collect()) == [("task", "x")]
    assert ("1", "desc", "p") in {tuple(r) for r in catalog.shared_entities(files, "sub", ()).collect()}


def test_files_without_entities_and_unknown_values_count(spark):
    files = spark.createDataFrame([("a", {"k": "1", "u": None}), ("a", {"k": "1", "u": None}), ("b", {"k": "1"}), ("b", None), ("c", {"k": "1"}), ("c", {}), (None, {"k": "1"})], "g string, entities map<string,string>")
    assert sorted(tuple(r) for r in catalog.shared_entities(files, "g").collect()) == [("a", "k", "1"), ("a", "u", None)]


def test_a_path_is_parsed_once(spark, tmp_path):
    spark.createDataFrame([("/d/sub-1_run-1_ieeg.vhdr",), ("/d/sub-1_run-2_ieeg.vhdr",)], "path string").write.parquet(str(tmp_path / "files"))
    files = catalog.with_entities(spark.read.parquet(str(tmp_path / "files")))
    assert plan_of(files.select("entities")).count("filter(split(") == 1
    shared = catalog.shared_entities(files, "sub")
    assert plan_of(shared).count("map_from_entries(") == 1 and plan_of(shared).count("Relation") == 1
    assert [tuple(r) for r in shared.collect()] == [("1", "sub", "1")]


def test_a_group_of_many_values_is_a_row_a_key_in_its_window(spark):
    files = spark.range(5000).select(F.when(F.col("id") % 5 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.create_map(F.lit("run"), F.col("id").cast("string"), F.lit("task"), F.lit("x")).alias("entities"))
    shared = catalog.shared_entities(files, "g")
    plan = plan_of(shared)
    assert plan.index("Window") < plan.index("Aggregate") and "Join" not in plan
    got = {tuple(r) for r in shared.collect()}
    assert ("hot", "task", "x") in got and ("hot", "run", "1") not in got and len(got) == 2001
