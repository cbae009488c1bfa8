"""Tables kept up by streams, with restarts and repeated deliveries, against the batch form."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.operators import ops
from corpusloom.streaming import operational as st

KIND = "event_id long, user_id int, kind string, plan string, ts timestamp_ntz"


def events(begin, end, day=0):
    kinds = ("charged", "activated", "cancelled", "completed")
    return [(i, i % 11, kinds[i * 7 % 4], "yearly" if i % 3 else "monthly", datetime(2024, 1, 1 + day) + timedelta(minutes=i * 37 % 600)) for i in range(begin, end)]


def test_subscriptions_over_restarts(spark, tmp_path):
    src, checkpoint, path = (str(tmp_path / n) for n in ("src", "checkpoint", "state"))
    all_ = []
    for load in (events(0, 40), events(40, 60, 1), events(0, 20), []):  # the third is told twice
        all_ += load
        spark.createDataFrame(load, KIND).repartition(2).write.mode("append").parquet(src)
        st.kept_up(st.subscriptions(spark.readStream.schema(KIND).parquet(src)), checkpoint, path, ["user_id"], 4)
        got = {tuple(r) for r in spark.read.parquet(path).select("user_id", "plan", "status", "until").collect()}
        want = {tuple(r) for r in ops.subscriptions(spark.createDataFrame(all_, KIND)).select("user_id", "plan", "status", "until").collect()}
        assert got == want and len(got) == 11


def test_uses_by_day(spark, tmp_path):
    src, checkpoint, path = (str(tmp_path / n) for n in ("src", "checkpoint", "state"))
    loads = [events(0, 40), events(40, 80), events(70, 80)]
    for load in loads:
        spark.createDataFrame(load, KIND).write.mode("append").parquet(src)
        st.kept_up(st.used_by_day(spark.readStream.schema(KIND).parquet(src)), checkpoint, path, ["user_id", "day"], 4)
    got = {tuple(r) for r in spark.read.parquet(path).select("user_id", "day", "used").collect()}
    whole = spark.createDataFrame(loads[0] + loads[1], KIND)
    assert got == {tuple(r) for r in st.used_by_day(whole.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert sum(r[2] for r in got) == 80
