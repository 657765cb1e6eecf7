"""The stateful list of best candidates against the batch operator, over batches, restarts and expiry."""

import random

from kerntrail.operators import trajectories
from kerntrail.streaming import best

SCHEMA = "key string, f double, step long"


def test_equals_the_batch_operator_after_replay_and_restart(spark, tmp_path):
    rng = random.Random(5)
    path, folder, rows = str(tmp_path / "visits"), str(tmp_path / "out"), []
    for run in range(2):
        more = [(rng.choice([f"s{rng.randrange(60)}", f"s{rng.randrange(60)}", None]), rng.choice([None, round(rng.uniform(-run, 5), 1)]), k) for k in range(80)]
        rows += more
        spark.createDataFrame(more, SCHEMA).repartition(2).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        got = [tuple(r) for r in best.best_candidates(spark, stream, 12, folder).collect()]
        want = trajectories.best_candidates(spark.createDataFrame(rows, SCHEMA).filter("key IS NOT NULL"), 12)
        assert got == [(r.key, r.f) for r in want.collect()]
    again = spark.readStream.schema(SCHEMA).parquet(path)
    assert [tuple(r) for r in best.best_candidates(spark, again, 12).collect()] == got


def test_states_expire(spark, tmp_path):
    path, folder = str(tmp_path / "visits"), str(tmp_path / "out")

    def run(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        return {r.key: r.f for r in best.best_candidates(spark, stream, 5, folder, expiry=10).collect()}

    assert run(("a", 1.0, 1), ("a", 3.0, 9)) == {"a": 1.0}
    assert run(("a", 4.0, 19), ("a", 2.0, 18), ("a", None, 40)) == {"a": 1.0}
    assert run(("a", 5.0, 30)) == {"a": 5.0}  # eleven steps later: the value of before has gone
