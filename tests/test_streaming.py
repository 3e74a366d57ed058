"""Streams end with the same rows as batches."""

from helixframe.streaming import ingest
from tests.test_structures import small_pdb


def test_ingest(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "one.pdb").write_text(small_pdb())
    (d / "bad.pdb").write_text("nothing here\n")
    run = lambda: ingest.ingest_structures(spark, str(d), f"{tmp_path}/atoms", f"{tmp_path}/failures", f"{tmp_path}/check").awaitTermination()
    run()
    (d / "two.pdb").write_text(small_pdb())
    run()
    run()
    a = spark.read.parquet(f"{tmp_path}/atoms")
    assert {r.structure_id: r["count"] for r in a.groupBy("structure_id").count().collect()} == {"one": 29, "two": 29}
    assert spark.read.parquet(f"{tmp_path}/failures").count() == 1


def test_windows(spark, tmp_path):
    df = spark.sql("SELECT timestamp_seconds(id * 37) AS ts, concat('t', id % 3) AS event_type, double(id) AS value FROM range(200)")
    df.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/events")
    q = ingest.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda rows: sorted(map(tuple, rows))
    assert key(spark.table("w").collect()) == key(ingest.windowed_counts(df).collect())
