"""Streaming twin of the lockout fold: state carried across micro-batches gives the batch result."""

import tempfile

from pyspark.sql import functions as F

from cohortlab.streaming import lockout as LK

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    base = tempfile.mkdtemp(prefix="cohortlab-stream-")
    # three time-ordered files -> three micro-batches (maxFilesPerTrigger = 1)
    bounds = ev.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    span = (bounds.hi - bounds.lo) / 3
    for i in range(3):
        lo, hi = bounds.lo + span * i, bounds.lo + span * (i + 1)
        part = ev.filter((F.col("ts") >= lo) & ((F.col("ts") < hi) if i < 2 else F.lit(True)))
        part.coalesce(1).write.mode("overwrite").parquet(f"{base}/in/part{i}")
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .parquet(f"{base}/in")
    q = LK.lockout_stream(src).writeStream.format("memory").queryName("lockout_out").outputMode("append") \
        .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination(600)
    got = sorted(tuple(r) for r in spark.table("lockout_out").select("key", "ts", "outcome", "fail_count").collect())
    want = sorted(tuple(r) for r in LK.failed_attempt_lockout(ev).select("key", "ts", "outcome", "fail_count").collect())
    assert len(want) > 0 and got == want
