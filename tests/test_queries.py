import pytest

from helpers import DATA, oracle, same
from radiolake.plans import CORE_QUERIES, CORE_SQL


@pytest.fixture(scope="module")
def con():
    return oracle("sf0.001")


@pytest.mark.parametrize("name", sorted(CORE_QUERIES))
def test_query_against_sql(spark, con, name):
    df = CORE_QUERIES[name](spark, f"{DATA}/sf0.001")
    rows = df.collect()
    if name in CORE_SQL:
        same(rows, df.columns, con.execute(CORE_SQL[name]))
    else:
        assert df.columns


def test_every_sql_has_its_query():
    assert set(CORE_SQL) <= set(CORE_QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_expressions_stay_in_the_jvm(spark):
    for name in ("reward_accuracy_multi", "composite_reward", "nudge", "slice_assignment", "p2_found", "rate_limit_audit"):
        plan = CORE_QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_scans_read_only_what_is_asked(spark):
    plan = CORE_QUERIES["annotations_per_image_describe"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(id)" in plan and "ingested_at" not in plan


def test_advantages_just_below_a_half(spark):
    """Of sf0.01 one advantage is -0.1044997: -0.104, though -0.105 if rounded to six places first."""
    df = CORE_QUERIES["group_advantage"](spark, f"{DATA}/sf0.01")
    same(df.collect(), df.columns, oracle("sf0.01").execute(CORE_SQL["group_advantage"]))
