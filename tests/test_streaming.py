import pytest

from lodestone.streaming.ingest import ingest, windowed_counts


def test_ingest_adds_each_text_once(spark, tmp_path):
    schema = "doc_id string, text string"
    got = []
    run = lambda: ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "stored"), str(tmp_path / "cp"), lambda df: got.extend(r.text for r in df.collect())).awaitTermination()
    spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a")], schema).write.parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame([("4", "b"), ("5", "c")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(got) == ["a", "b", "c"]


def test_ingest_after_a_failed_sink(spark, tmp_path):
    schema = "doc_id string, text string"
    runs = []

    def failing(df):
        runs.append(sorted((r.batch, r.text) for r in df.collect()))
        if len(runs) == 2:
            raise ValueError("lost")

    def run():
        ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "stored"), str(tmp_path / "cp"), failing).awaitTermination()

    spark.createDataFrame([("1", "a")], schema).write.parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame([("2", "a"), ("3", "b"), ("4", "c")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert runs == [[(0, "a")], [(1, "b"), (1, "c")], [(1, "b"), (1, "c")]]
    assert sorted((r.batch, r.text) for r in spark.read.parquet(str(tmp_path / "stored")).collect()) == [(0, "a"), (1, "b"), (1, "c")]


def test_counts_leave_out_what_is_later_than_the_watermark(spark, tmp_path):
    schema = "event_type string, ts timestamp"
    path = str(tmp_path / "events")

    def add(*rows):
        spark.createDataFrame(rows, "event_type string, ts string").selectExpr("event_type", "CAST(ts AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(path)
        q = windowed_counts(spark.readStream.schema(schema).parquet(path)).select("event_type", "window.start", "n")
        q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    add(("x", "2024-01-01 00:10:00"), ("x", "2024-01-01 00:50:00"), ("y", "2024-01-01 00:20:00"))
    add(("x", "2024-01-01 03:00:00"))  # closes the first hour
    add(("x", "2024-01-01 00:59:00"), ("x", "2024-01-01 05:00:00"))  # the first of these is too late
    got = {(r.event_type, str(r.start), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("x", "2024-01-01 00:00:00", 2), ("y", "2024-01-01 00:00:00", 1), ("x", "2024-01-01 03:00:00", 1)}
