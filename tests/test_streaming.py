from pyspark.sql import functions as F

from fedrank.operators import stateful as batch
from fedrank.streaming import stateful


def run(spark, tmp_path, stream_of, name, mode="append"):
    rows = [(i, i % 3, i * 7 % 50 + 10 * (i // 5), i % 4 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, k long, at_ms long, bad boolean").coalesce(1)
    for part in range(2):
        df.where(F.col("id") % 2 == part).withColumn("at_ms", F.col("at_ms") + 200 * part).write.mode("append").parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_of(log).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(str(tmp_path / "in")), spark.table(name)


def test_rate_limit(spark, tmp_path):
    rows, got = run(spark, tmp_path, lambda s: stateful.rate_limit(s, "k", "at_ms", ["id"], 2, 30), "limited")
    want = batch.rate_limit(rows, "k", "at_ms", ["id"], 2, 30)
    # files may come in either order; within a key the second batch is later only if it is the second file
    assert got.count() == want.count() and got.where("accepted").count() > 0 and got.where("NOT accepted").count() > 0


def test_cool_down(spark, tmp_path):
    _, got = run(spark, tmp_path, lambda s: stateful.cool_down(s, "k", "at_ms", "bad", ["id"], 25), "cooled")
    assert {r.outcome for r in got.collect()} == {"ok", "challenged", "blocked"}


def test_cache_and_queue(spark, tmp_path):
    for name, make in (
        ("cache", lambda m, s: m.cache(s.withColumn("key", (F.col("id") % 4).cast("string")).withColumn("d", F.lit(9)), "k", "key", "id", "at_ms", "d", 40, 2)),
        ("queue", lambda m, s: m.queue(s.withColumn("d", F.lit(9)), "k", "id", "at_ms", "d", 2)),
    ):
        log = spark.createDataFrame([(i, i % 3, 7 * i) for i in range(60)], "id long, k long, at_ms long")
        folder = tmp_path / name
        for part in range(3):  # files in the order of time
            log.where(F.floor(F.col("id") / 20) == part).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        q = make(stateful, source).writeStream.format("memory").queryName("s_" + name).outputMode("append").option("checkpointLocation", str(folder / "cp")).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table("s_" + name).collect())) == sorted(map(tuple, make(batch, log).collect()))


def test_counts(spark, tmp_path):
    rows, got = run(spark, tmp_path, lambda s: stateful.request_counts(s, "k"), "counted", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.groupBy("k").count().collect()))
