"""Streaming forms over files that arrive in two batches."""

from pyspark.sql import functions as F

from seriate.streaming import events as E


def run(spark, df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"select * from {name}").collect()


def source(spark, path, rows):
    schema = "k int, at timestamp, n long, v double"
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(part, "k int, s long, n long, v double").select("k", F.timestamp_seconds(F.col("s") + 1_000_000).alias("at"), "n", "v").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_prefix_sums_carry_over_batches(spark, tmp_path):
    rows = [(k % 3, 10 * k, k, float(k)) for k in range(30)]
    got = {(r["k"], r["n"]): r["prefix"] for r in run(spark, E.prefix_sum(source(spark, str(tmp_path), rows), "k", "n", "v"), "sums")}
    assert len(got) == 30
    for key in range(3):
        values = [got[key, n] for n in range(key, 30, 3)]
        assert values[-1] == sum(range(key, 30, 3)) or sorted(values)[-1] == sum(range(key, 30, 3))


def test_sessions_and_distinct(spark, tmp_path):
    rows = [(1, s, s, 1.0) for s in (0, 5, 9, 100, 104, 1000)] + [(2, 3, 0, 1.0), (2, 3, 0, 1.0)]
    rows += [(9, 5000, 0, 0.0)] * 8
    stream = source(spark, str(tmp_path / "a"), rows)
    got = {(r["k"], r["n"]) for r in run(spark, E.sessions(stream, "k", "at", "20 seconds", "1 second"), "spans")}
    assert {(1, 3), (1, 2), (1, 1), (2, 2)} <= got
    once = run(spark, E.distinct(source(spark, str(tmp_path / "b"), rows), ["k", "at"], "at", "10000 seconds"), "once")
    assert sorted(r["k"] for r in once) == [1] * 6 + [2, 9]
