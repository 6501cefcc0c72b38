"""Tables that grow are never sent whole to the driver and every executor, small as their files may look."""

import pytest

from quillon import session
from quillon.operators import edits, match

LIMIT = "spark.sql.autoBroadcastJoinThreshold"


def plan_of_last_run(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()


@pytest.fixture
def grown(spark, tmp_path):
    """A table of 4 MB in files, under the session's limit of 10 MB."""
    spark.range(500_000).selectExpr("id", "id AS other").write.parquet(f"{tmp_path}/grown")
    return spark.read.parquet(f"{tmp_path}/grown")


def test_steps_send_no_table_that_grows(spark, grown):
    joined = grown.join(grown.selectExpr("other AS id", "id AS more"), "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get(LIMIT)
    found = session.written(joined, "joined")
    assert "BroadcastHashJoin" not in plan_of_last_run(spark)
    assert spark.conf.get(LIMIT) == before and found.count() == 500_000


def test_a_lower_limit_of_the_session_holds(spark):
    before = spark.conf.get(LIMIT)
    try:
        for limit in ("-1", "1k"):
            spark.conf.set(LIMIT, limit)
            with session.small_broadcasts(spark):
                assert spark.conf.get(LIMIT) == limit
    finally:
        spark.conf.set(LIMIT, before)


def test_spliced_runs_are_not_sent(spark):
    runs = spark.createDataFrame([(1, "some text", True, False, None)], "run_id long, text string, editable boolean, whole boolean, characters array<string>")
    asked = spark.createDataFrame([(1, 1, 0, 4, "any", 0)], "edit_id long, run_id long, start int, end int, new_text string, group long")
    changed, _ = edits.apply_edits(asked, runs)
    assert [tuple(r) for r in changed.collect()] == [(1, "any text", 1)]
    assert "BroadcastHashJoin" not in plan_of_last_run(spark)


def test_requests_that_ask_the_same_are_joined_once(spark):
    fonts = spark.createDataFrame([(i, f"Font{i % 3}", "Fam", False, False, 400, None, ["a", "b"]) for i in range(60)], "ord long, ps_name string, family string, bold boolean, italic boolean, weight int, priority boolean, characters array<string>")
    asked = spark.createDataFrame([(i, "Fam", None if i % 2 else False, False, 400, ["b", "a"][:: 1 - i % 2 * 2]) for i in range(100)], "request_id long, name string, bold boolean, italic boolean, weight int, characters array<string>")
    found = match.donor_choice(asked, fonts)
    assert sorted(map(tuple, found.collect())) == [(i, 0, 2 if i % 2 else 1) for i in range(100)]
    assert "BroadcastHashJoin" not in plan_of_last_run(spark)
