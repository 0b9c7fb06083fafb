"""Result tables of streams lie in the shared folder, not on the driver."""

from factloom.streaming import logs


def test_run_once_writes_its_table(spark, tmp_path):
    spark.range(100).selectExpr("id % 7 AS k").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for df, mode, want in ((stream().groupBy("k").count(), "complete", [(k, 15 if k < 2 else 14) for k in range(7)]), (stream(), "append", sorted((i % 7,) for i in range(100)))):
        got = logs.run_once(df, mode, str(tmp_path / mode))
        assert sorted(map(tuple, got.collect())) == want
        assert any(f.startswith(str(tmp_path / mode)) or f.startswith(f"file://{tmp_path / mode}") for f in got.inputFiles())
    empty = spark.readStream.schema("k bigint").parquet(str((tmp_path / "none").mkdir() or tmp_path / "none"))
    assert logs.run_once(empty, "append", str(tmp_path / "e")).count() == 0
