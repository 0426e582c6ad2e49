"""Streams that start again where they stopped."""

from datetime import datetime, timedelta

from emberlint.streaming import streams

SCHEMA = "row_id long, source_code string, at timestamp"


def test_each_program_once(spark, tmp_path):
    """Replayed rows, also after a restart, give nothing; a program comes again once its time to be kept has passed."""
    began = datetime(2024, 1, 1)

    def deliver(name, rows):
        spark.createDataFrame([(k, c, began + timedelta(hours=h)) for k, c, h in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        read = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
        kept = streams.first_programs(read, "at", "24 hours")
        q = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.source_code, r.row_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    deliver("a", [(1, "int x;", 0), (2, "int y;", 1), (3, None, 1)])
    assert run() == [("int x;", 1), ("int y;", 2)]
    deliver("b", [(4, "int x;", 2), (5, "int z;", 2), (6, "int z;", 2)])
    first = run()
    assert [c for c, _ in first] == ["int x;", "int y;", "int z;"] and first[:2] == [("int x;", 1), ("int y;", 2)]
    deliver("c", [(7, "later", 100)])
    run()
    deliver("d", [(8, "int x;", 101), (9, "later", 101)])
    assert [x for x in run() if x not in first] == [("int x;", 8), ("later", 7)]


def test_a_batch_keeps_first_rows(spark):
    rows = [(1, "a", datetime(2024, 1, 2)), (2, "a", datetime(2024, 1, 1)), (3, None, datetime(2024, 1, 1))]
    assert [r.row_id for r in streams.first_programs(spark.createDataFrame(rows, SCHEMA), "at").collect()] == [2]
