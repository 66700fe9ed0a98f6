"""Claims as keyed state: one claim an attempt, crashes, replays and leases that end."""

import sys
import time
from itertools import product

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from earshot.streaming import claims

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def append(spark, log, name, *events):
    spark.createDataFrame([(i, e, a, n) for n, (i, e, a) in enumerate(events)], claims.EVENT).write.parquet(f"{log}/{name}")


def drain(spark, log, checkpoint, work, lease=3600.0):
    claims.run_claims(spark, log, work, checkpoint, lease).awaitTermination()


def test_steps():
    fits = {("new", "ready"): "pending", ("failed", "retry"): "pending", ("done", "reindex"): "pending", ("processing", "done"): "done", ("processing", "failed"): "failed"}
    for status, event in product(("new", "pending", "processing", "failed", "done"), ("ready", "retry", "reindex", "done", "failed", "x", None)):
        assert claims.step(status, 2, event, 2) == fits.get((status, event), status)
        assert claims.step(status, 2, event, 1) == (status if event in claims.ENDS else fits.get((status, event), status))


def test_each_episode_once_and_again_when_asked(spark, tmp_path):
    log, checkpoint, seen = str(tmp_path / "log"), str(tmp_path / "ck"), []

    def work(batch, name):
        seen.extend((r.episode_id, r.attempt) for r in batch.collect())
        return batch.withColumn("event", F.when(F.col("episode_id") == 2, "failed").otherwise("done"))

    append(spark, log, "a", *[(i, "ready", None) for i in (1, 2, 3, 3, None)], (4, "retry", None))
    drain(spark, log, checkpoint, work)
    assert sorted(seen) == [(1, 1), (2, 1), (3, 1)]
    append(spark, log, "b", (1, "ready", None), (3, "done", 1))  # the ends of the first batch are read here too
    drain(spark, log, checkpoint, work)
    assert len(seen) == 3
    append(spark, log, "c", (1, "reindex", None), (2, "retry", None), (3, "retry", None), (9, "ready", None))
    drain(spark, log, checkpoint, work)
    assert sorted(seen[3:]) == [(1, 2), (2, 2), (9, 1)]


def test_a_crash_replays_the_same_claims(spark, tmp_path):
    log, checkpoint, seen = str(tmp_path / "log"), str(tmp_path / "ck"), []

    def work(batch, name):
        seen.append((name, sorted((r.episode_id, r.attempt) for r in batch.collect())))
        if len(seen) == 1:
            raise RuntimeError("lost")
        return batch.withColumn("event", F.lit("done"))

    append(spark, log, "a", (1, "ready", None), (2, "ready", None))
    with pytest.raises(Exception, match="lost"):
        drain(spark, log, checkpoint, work)
    drain(spark, log, checkpoint, work)
    assert [s for s in seen if s[1]] == [("batch-000000000", [(1, 1), (2, 1)])] * 2
    ended = spark.read.schema(claims.EVENT).option("recursiveFileLookup", "true").parquet(f"{log}/ended-000000000")
    assert sorted((r.episode_id, r.attempt, r.event) for r in ended.collect()) == [(1, 1, "done"), (2, 1, "done")]


def test_a_lease_that_ends_is_claimed_anew(spark, tmp_path):
    log, checkpoint, seen = str(tmp_path / "log"), str(tmp_path / "ck"), []

    def work(batch, name):
        own = sorted((r.episode_id, r.attempt) for r in batch.collect())
        seen.extend(own)
        return batch.where("attempt > 1").withColumn("event", F.lit("done"))  # the first worker never ends

    append(spark, log, "a", (1, "ready", None))
    drain(spark, log, checkpoint, work, lease=1.0)
    time.sleep(1.5)
    append(spark, log, "b", (5, "other", None))
    drain(spark, log, checkpoint, work, lease=1.0)
    assert (1, 1) in seen and (1, 2) in seen
    append(spark, log, "c", (1, "failed", 1))  # too late: its attempt is over
    drain(spark, log, checkpoint, work, lease=1.0)
    append(spark, log, "d", (1, "retry", None))
    time.sleep(1.5)
    drain(spark, log, checkpoint, work, lease=1.0)
    assert sorted(set(seen)) == [(1, 1), (1, 2)]
