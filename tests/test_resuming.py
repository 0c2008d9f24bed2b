import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import batches as B
from vellum.operators import checkpoints as K
from vellum.streaming import states as S

CHANGE = "k string, status string, ts timestamp_ntz, id long"


def test_states_in_any_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = spark.range(240).selectExpr("concat('b', id % 9) as k", "id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, (id * 7919) % 60) as ts", "element_at(array('pending', 'downloading', 'processing', 'failed', 'completed', null), cast(id * 31 % 6 + 1 as int)) as status").select("k", "status", "ts", "id").collect()
    rng.shuffle(rows)
    rows.append(("none", "pending", None, 1))
    folder = tmp_path / "in"
    for n in range(6):
        spark.createDataFrame(rows[n::6], CHANGE).coalesce(1).write.mode("append").parquet(str(folder))
        if n in (2, 5):  # ends and is started again
            stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 2).parquet(str(folder))
            S.kept(S.states(stream, "k", "status", "ts", "id"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = S.last_updates(spark.read.parquet(str(tmp_path / "out")), "k").drop("stale")
    want = B.current(spark.createDataFrame(rows, CHANGE).where("ts is not null"), "k", "status", "ts", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 9
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() > 2


def test_batches_without_a_change_are_marked(spark, tmp_path):
    rows = [("a", "downloading", "2024-01-01 00:00:00", 1), ("b", "completed", "2024-01-01 00:00:00", 2), ("c", "processing", "2024-01-01 09:00:00", 3), ("d", "pending", "2024-01-01 10:00:00", 4), ("d", "pending", "2024-01-01 10:30:00", 5)]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], "k string, status string, ts string, id long").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(CHANGE).parquet(str(tmp_path / "in"))
        S.kept(S.states(stream, "k", "status", "ts", "id", stale="2 hours", delay="10 minutes"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.k: (r.status, r.stale) for r in S.last_updates(spark.read.parquet(str(tmp_path / "out")), "k").collect()}
    assert got == {"a": ("downloading", True), "b": ("completed", False), "c": ("processing", False), "d": ("pending", False)}


def test_each_record_once_whatever_ends_a_run(spark, tmp_path):
    root, seen = str(tmp_path), []
    content = {"a": ["a1", "a2"], "b": ["b1"], "c": []}
    archives = lambda **sizes: spark.createDataFrame([(n, s, 5) for n, s in sizes.items()], "name string, size long, modified long")

    def parse(rows):
        names = sorted(r.name for r in rows.collect())
        seen.append(names)
        return spark.createDataFrame([(n, x) for n in names for x in content[n]], "name string, record string")

    found = lambda df: sorted(r.record for r in df.collect())
    assert found(K.process(archives(a=1, b=1), parse, root)) == ["a1", "a2", "b1"]
    assert found(K.process(archives(a=1, b=1), parse, root)) == ["a1", "a2", "b1"] and seen == [["a", "b"]]
    with pytest.MonkeyPatch.context() as m:  # killed between records and checkpoints
        def killed(*_, **__):
            raise KeyboardInterrupt

        m.setattr(K.F, "current_timestamp", killed)
        with pytest.raises(KeyboardInterrupt):
            K.process(archives(a=1, b=2, c=1), parse, root)
    assert found(K.records(archives(a=1, b=1), root)) == ["a1", "a2", "b1"]
    assert found(K.records(archives(a=1, b=2, c=1), root)) == ["a1", "a2"]
    content["b"] = ["b2", "b3"]
    assert found(K.process(archives(a=1, b=2, c=1), parse, root)) == ["a1", "a2", "b2", "b3"] and seen[-1] == ["b", "c"]
    content["a"] = []
    assert found(K.process(archives(a=9, b=2, c=1), parse, root)) == ["b2", "b3"] and seen[-1] == ["a"]
    assert found(K.process(archives(b=2), parse, root, options="no images")) == ["b2", "b3"] and seen[-1] == ["b"]
    assert {r.name: r.records for r in K.checkpoints(archives(a=9, b=2, c=1), root).collect()} == {"a": 0, "b": 2, "c": 0}
    assert K.records(archives(a=1), str(tmp_path / "new")) is None


def test_a_stream_without_timers_is_an_aggregate(spark, tmp_path):
    stream = spark.readStream.schema(CHANGE).parquet(str(tmp_path))
    plan = S.states(stream, "k", "status", "ts", "id")._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan
