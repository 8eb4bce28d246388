from leafmill import streaming
from leafmill.sources import table


def test_word_counts_of_a_stream(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text", "received_at")
    folder = str(tmp_path / "in")
    docs.write.parquet(folder)
    docs.limit(10).write.mode("append").parquet(folder)  # delivered again
    stream = streaming.once_within(streaming.document_stream(spark, folder, docs.schema), "doc_id", "received_at", "3650 days")
    q = streaming.word_counts(stream).writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").count() == docs.count()
