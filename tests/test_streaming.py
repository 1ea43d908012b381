import datetime

from tessera.streaming.feed import FEED, facts_after, keep_facts


def test_facts_follow_a_feed(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "facts")
    day = datetime.datetime(2024, 1, 1)

    def put(*rows):
        spark.createDataFrame([(p, "python", t, t is None, day + datetime.timedelta(seconds=k)) for k, (p, t) in enumerate(rows)], FEED).coalesce(1).write.mode("append").parquet(feed)
        keep_facts(spark.readStream.schema(FEED).parquet(feed), out, str(tmp_path / "state")).awaitTermination()

    names = lambda k: sorted(r["name"] for r in facts_after(spark, out, k).selectExpr("inline(symbols)").collect())
    put(("a.py", "def one(): pass"), ("b.py", "def two(): pass"), ("a.py", "def three(): pass"))
    assert names(0) == ["three", "two"]
    put(("b.py", None), ("c.py", "def four(): pass"))
    assert names(1) == ["four", "three"]
