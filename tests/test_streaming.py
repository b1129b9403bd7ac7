"""Running sample counts over two batches of a stream."""

from cladeflow.streaming.cumulative import sample_counts


def test_running_counts(spark, tmp_path):
    schema = "gene string, sample string, sequence string"
    clusters = spark.createDataFrame([("m", "AAAA", "AAAA"), ("m", "AA-A", "AAAA")], "gene string, member string, rep string")
    for rows in ([("m", "A", "AAAA"), ("m", "A", "AANA")], [("m", "A", "AAAA"), ("m", "B", "AAAA"), ("m", "C", "TTTT")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = sample_counts(stream, clusters).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        assert [tuple(r) for r in spark.table("running").collect()] == [("m", "AAAA", 2)]
    finally:
        query.stop()
