"""Stateless expressions run unchanged on a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatlake.functions import labels as L
from threatlake.functions import times as T


def test_projection_on_a_stream(spark, data, tmp_path):
    data.events.write.parquet(str(tmp_path / "in"))

    def shape(df):
        label = F.when(F.col("event_type") == "error", "DDoS").otherwise("BENIGN")
        return df.select("event_id", L.attack_family(label).alias("family"), T.date_key(F.col("ts")).alias("date_sk"))

    stream = spark.readStream.schema(data.events.schema).parquet(str(tmp_path / "in"))
    query = shape(stream).writeStream.format("memory").queryName("shaped").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(spark.table("shaped").collect()) == sorted(shape(data.events).collect())
