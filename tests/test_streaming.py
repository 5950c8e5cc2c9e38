"""Gates and prediction sets run unchanged on a stream."""

from pyspark.sql import functions as F

from alertsieve.functions.probs import confidence, predicted, prediction_set, set_size
from alertsieve.operators.gating import gate
from alertsieve.sources.tables import scores


def test_stateless_on_stream(spark, tmp_path):
    rows = scores(spark, "/root/testdata/sf0.001").select("id", "pa")
    rows.write.parquet(str(tmp_path / "in"))

    def job(df):
        df = df.withColumns({"pred": predicted(F.col("pa")), "conf": confidence(F.col("pa"))})
        df = gate(df, 0.5).withColumn("n", set_size(F.col("pa"), F.lit(0.9)))
        return df.select("id", "gated", F.array_join(prediction_set(F.col("pa"), F.col("n")).cast("array<string>"), ",").alias("s"))

    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = job(stream).writeStream.format("memory").queryName("gated_rows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.sql("SELECT * FROM gated_rows").collect()) == sorted(job(rows).collect())
