from datetime import datetime, timedelta

from weftline.streaming.alerts import intake, new_alerts, run_each, window_counts


def test_counts_equal_batch(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(hours=i), f"p{i % 3}", f"fp{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, who string, fingerprint string")
    src = str(tmp_path / "in")
    df.repartition(8).write.parquet(src)
    stream = intake(spark, src, df.schema)
    got = []
    run_each(stream, lambda b, _: got.extend(r.id for r in b.select("id").collect()), str(tmp_path / "c0")).awaitTermination(120)
    assert sorted(got) == list(range(200))

    q = window_counts(stream, "ts", ["who"], "1 day", late="40 days").writeStream.outputMode("complete").format("memory").queryName("wc").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r["start"], r.who): r.n for r in window_counts(df, "ts", ["who"], "1 day").collect()}
    assert {(r["start"], r.who): r.n for r in spark.sql("select * from wc").collect()} == want

    q = new_alerts(stream, "ts", "40 days").writeStream.format("memory").queryName("na").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select count(*) n, count(distinct fingerprint) d from na").first()[:] == (7, 7)
