"""What the nulls of stored maps shuffle, and odd pools."""

import pytest

from voltaic.operators import nulls
from voltaic.plans import queries

SCHEMA = "roi string, unit long, perm int, t_idx int, v double, v_b double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pool(n=5, known=lambda roi, u, p, t: True):
    return [(roi, u, p, t, *((float((u * 7 + p * 5 + t * 3 + c) % 11 - 4) if known(roi, u, p, t) else None) for c in (0, 1))) for roi in ("r1", "r2") for u in range(n) for p in range(2 + u % 2) for t in range(7)]


def null(spark, rows, paired=True, by=("roi",), **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = nulls.group_null(df if paired else df.drop("v_b"), 20, list(by), threshold=0.4, width=3, **kw).collect()
    return sorted((*(r[c] for c in by), r["iter"], round(r["null"], 9)) for r in found)


@pytest.mark.parametrize("paired", [True, False])
@pytest.mark.parametrize("flip", [True, False])
def test_values_are_shuffled_once(spark, paired, flip):
    df = spark.createDataFrame(pool(), SCHEMA)
    plan = plan_of(nulls.group_null(df if paired else df.drop("v_b"), 20, ["roi"], threshold=0.4, width=3, flip=flip)).splitlines()
    kinds = [kind for line in plan for kind in ("MapInArrow", "collect_list(", "Join", "Exchange") if kind in line]
    # From the statistics down: what is collected comes from one exchange, by block, and sizes are not joined to it.
    assert kinds[:6] == ["MapInArrow", "Exchange", "MapInArrow", "collect_list(", "collect_list(", "Exchange"] and "Join" not in kinds
    assert "hashpartitioning(roi#" in next(line for line in plan[::-1] if "_block#" in line and "REPARTITION_BY_COL" in line)


@pytest.mark.parametrize("name", ["null_of_paired_maps", "null_of_stored_maps"])
def test_pools_are_shuffled_once(spark, sf, name):
    """Sizes and values read the same shuffle of the pools."""
    df = queries.QUERIES[name](spark, sf)
    assert df.count() > 0
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning(label") == 2 and final.count("ReusedExchange") == 1


@pytest.mark.parametrize("paired", [True, False])
def test_odd_rows(spark, paired):
    rows = pool()
    want = null(spark, rows, paired)
    assert len(want) == 40 and len({x[2] for x in want}) > 10
    odd = [(None, 0, 0, 0, 9.0, 9.0), ("r1", None, 0, 0, 9.0, 9.0), (None, None, 1, 2, None, 9.0)]
    assert null(spark, rows + odd, paired) == want  # of an unknown region or contribution
    assert null(spark, rows * 2, paired) == want  # each row twice
    silent = [("r1", 9, p, t, None, None) for p in range(9) for t in range(7)]
    assert null(spark, rows + silent, paired) == want  # a contribution without any value
    half = [("r1", 9, p, t, None, 5.0) for p in range(9) for t in range(7)]
    assert null(spark, rows + half, paired) == want  # one condition has no map
    late = [("r1", u, 4, t, None, None) for u in range(5) for t in range(7)]
    assert null(spark, rows + late, paired) == want  # maps without any value are not drawn
    unknown = [("r3", 0, 0, t, None, None) for t in range(7)]
    assert null(spark, rows + unknown, paired) == want + [("r3", i, 0.0) for i in range(20)]
    assert null(spark, [], paired) == []
    assert null(spark, [x for x in rows if x[0] == "r1"], paired, by=()) == [x[1:] for x in want if x[0] == "r1"]


def test_one_size_for_all_blocks(spark):
    """A map that is known in one block only counts as a map in all of them: the others may draw it, and have nothing then."""
    rows = pool(known=lambda roi, u, p, t: p == 0 or t < 3)
    df = spark.createDataFrame(rows, SCHEMA).drop("v_b")

    def draw(iterations, unit, n):
        assert n == 2 + unit % 2
        return (iterations + unit) % n

    got = {(r.roi, r["iter"]): r["null"] for r in nulls.group_null(df, 6, ["roi"], threshold=1e9, width=3, draw=draw).collect()}
    assert len(got) == 12 and set(got.values()) == {0.0}


def test_a_block_from_two_tasks_is_an_error(spark):
    runs = "roi string, _block long, best array<double>, head array<double>, tail array<double>, whole array<boolean>"
    twice = spark.createDataFrame([("r", 0, [1.0], [0.0], [0.0], [False])] * 2, runs)
    with pytest.raises(Exception, match="comes from two tasks"):
        nulls._merged(twice, ["roi"]).collect()
