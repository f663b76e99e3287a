from sitelake import plugins
from sitelake.sources import sinks
from sitelake.streaming import windows


def test_write_semantics(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "z"), (2, "b"), (2, "c"), (None, "m")], "k int, v string")
    rows = lambda df: sorted(map(repr, map(tuple, df.select("k", "v").collect())))
    assert rows(sinks.first_wins(old, new, ["k"], "v")) == sorted(map(repr, [(1, "a"), (None, "n"), (2, "b")]))
    assert rows(sinks.last_wins(old, new, ["k"], "v")) == sorted(map(repr, [(1, "z"), (None, "m"), (2, "c")]))
    assert rows(sinks.append_distinct(old, new, ["k"], "v")) == sorted(map(repr, [(1, "a"), (None, "n"), (2, "b")])) and sinks.truncated(old).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "map.xml").write_text('<urlset xmlns="http://s"><url><loc> https://a/ </loc></url><url><loc>https://b/</loc></url></urlset>')
    assert {r["url"] for r in sinks.sitemap_urls(spark, str(tmp_path / "map.xml")).collect()} == {"https://a/", "https://b/"}
    (tmp_path / "u.csv").write_text("id,urls\n1,https://a/\n2,\n")
    (tmp_path / "u.txt").write_text("https://a/\n\nhttps://b/\n")
    assert sinks.url_list(spark, str(tmp_path / "u.csv")).count() == 1 and sinks.url_list(spark, str(tmp_path / "u.txt")).count() == 2
    df = spark.createDataFrame([(1, ["x", "y"])], "id int, tags array<string>")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()["tags"] == '["x","y"]'


def test_plugins_and_reports(spark):
    @plugins.plugin("count")
    def count(session, root, n=1):
        return session.range(n)

    assert plugins.run("count", spark, "", n=3).count() == 3 and "count" in plugins.names()
    rows = spark.createDataFrame([(1, "a", "2020-01-01"), (2, "a", "2021-01-01"), (3, "b", "2022-01-01")], "id int, lib string, created_at string")
    assert sinks.latest_report(rows, lib="a").first()["id"] == 2


def test_windows_stream(spark, tmp_path):
    table = spark.createDataFrame([(1, "2020-01-01 05:00:00", 200), (2, "2020-01-01 06:00:00", 200), (3, "2020-01-02 06:00:00", 404)], "id long, created_at string, status_code int")
    table.selectExpr("id", "cast(created_at as timestamp) created_at", "status_code").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, created_at timestamp, status_code int").parquet(str(tmp_path / "in"))
    q = windows.status_counts(stream)
    run = q.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {(r["status_code"], r["n"]) for r in spark.table("counts").collect()} == {(200, 2), (404, 1)}


def test_flushed_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2020-01-01 05:00:00", 200), (1, "2020-01-01 05:00:00", 200)], "id long, created_at string, status_code int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, created_at string, status_code int").parquet(str(tmp_path / "in"))
    windows.flushed(windows.first_seen(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
