"""Steps of the corpus operators send no table whole that grows, small as its files may look."""

from quillon.llm import dart_minhash, staging


def plan_of_last_run(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()


def test_exploded_arrays_are_not_sent(spark, tmp_path):
    spark.range(20_000).selectExpr("id", "transform(sequence(1, 32), x -> xxhash64(id, x)) AS bands").write.parquet(f"{tmp_path}/sets")
    places = spark.read.parquet(f"{tmp_path}/sets").selectExpr("id", "explode(bands) AS hash")
    joined = places.join(places.groupBy("hash").count(), "hash")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert staging.materialise(joined, "joined").count() == 640_000
    assert "BroadcastHashJoin" not in plan_of_last_run(spark)


def test_classes_are_not_sent(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "another one")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dart_minhash.drop_near_duplicates(docs).collect()) == [1, 3]
    assert "BroadcastHashJoin" not in plan_of_last_run(spark)
