"""Streams against the same events as tables, and session rotation by cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from marginalia.streaming import sessions as S
from marginalia.streaming import stateful as Z


def result(events, spark, life=1000):
    df = spark.createDataFrame(events, S.EVENT)
    return {r.seq: (r.result, r.revoked) for r in S.rotated(df, life).collect()}


def test_rotation_by_cases(spark):
    events = [
        (1, 1, 1, "issue", "a", None), (1, 2, 2, "issue", "b", None), (1, 3, 3, "refresh", "a", "c"), (1, 4, 4, "refresh", "a", "d"), (1, 5, 5, "refresh", "c", "e"), (1, 6, 6, "issue", "f", None),
        (1, 7, 7, "logout", "f", None), (1, 8, 8, "logout", "f", None), (1, 9, 9, "refresh", None, "g"), (1, 10, 10, "issue", "h", None), (1, 2000, 11, "refresh", "h", "i"), (1, 2001, 12, "refresh", "nope", "i"),
        (2, 1, 13, "issue", "x", None), (2, 2, 14, "deactivate", None, None), (2, 3, 15, "refresh", "x", "y"), (2, 4, 16, "refresh", "x", "y"), (2, 5, 17, "issue", "z", None), (None, 1, 18, "refresh", "a", "b"),
    ]
    ok, bad, reused = ("OK", 0), (S.INVALID, 0), S.REUSED
    assert result(events, spark) == {
        1: ok, 2: ok, 3: ("OK", 1), 4: (reused, 2), 5: (reused, 0), 6: ok, 7: ("OK", 1), 8: ok, 9: bad, 10: ok, 11: bad, 12: bad, 13: ok, 14: ok, 15: (S.INVALID, 1), 16: (reused, 0), 17: ("ACCOUNT_DEACTIVATED", 0), 18: bad,
    }
    assert S.rotated(spark.createDataFrame([], S.EVENT)).count() == 0


def run_stream(spark, tmp_path, name, rows, schema, transform, batches=3):
    """The rows in files that a stream reads one at a time; what it gives as a table."""
    src, out = tmp_path / name, tmp_path / f"{name}-out"
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start(str(out))
    until = time.time() + 60  # timers keep such a query busy, so it is stopped once it has read everything
    while sum(p.numInputRows for p in query.recentProgress) < len(rows) and query.isActive and time.time() < until:
        time.sleep(0.3)
    query.stop()
    return spark.read.parquet(str(out))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_rotation_over_a_stream_equals_the_table(rocks, tmp_path):
    pytest.importorskip("google.protobuf")
    rng = random.Random(7)
    events, now = [], 4_000_000_000_000_000  # far ahead, so that no token expires by the clock
    for seq in range(120):
        kind = rng.choice(["issue", "refresh", "refresh", "refresh", "logout"])
        token = str(seq) if kind == "issue" else str(rng.randint(max(0, seq - 12), seq))
        events.append((rng.randint(1, 3), now + seq, seq, kind, token, str(seq)))
    got = run_stream(rocks, tmp_path, "sessions", events, S.EVENT, S.rotated_stream)
    want = S.rotated(rocks.createDataFrame(events, S.EVENT))
    key = lambda df: sorted((r.seq, r.user_id, r.result, r.revoked) for r in df.collect())
    assert key(got) == key(want) and got.filter(f"result = '{S.REUSED}'").count() > 0


def test_limits_over_a_stream_equal_the_table(spark, tmp_path):
    rng = random.Random(8)
    hits = sorted([(rng.choice("abc"), k, rng.randint(0, 3000) * 1_000_000) for k in range(150)], key=lambda h: h[2])
    schema = "key string, id long, at long"
    got = run_stream(spark, tmp_path, "hits", hits, schema, lambda s: Z.limited_stream(s, 600_000_000, 5))
    want = Z.limited(spark.createDataFrame(hits, schema), 600_000_000, 5)
    key = lambda df: sorted((r.key, r.id, r.allowed) for r in df.collect())
    assert key(got) == key(want) and 0 < got.filter("allowed").count() < 150


def test_first_reads_over_a_stream(spark, tmp_path):
    rows = [("g", k % 4, f"2024-01-01 00:{k:02d}:00") for k in range(30)]
    got = run_stream(spark, tmp_path, "reads", rows, "guest string, article long, at string", lambda s: Z.first_reads_stream(s.selectExpr("guest", "article", "cast(at as timestamp) as at")))
    assert sorted(r.article for r in got.collect()) == [0, 1, 2, 3]


def test_fan_out_in_slices_gives_the_same_mails(spark):
    users = spark.createDataFrame([(k, k % 5 > 0, k % 3 > 0) for k in range(40)], "user_id long, active boolean, wants_mail boolean")
    published = spark.createDataFrame([(k, k % 7) for k in range(30)], "article long, author long")
    want = sorted((a, u) for a in range(30) for u in range(40) if u % 5 and u % 3 and u != a % 7)
    for size in (7, 1000):
        assert sorted(map(tuple, Z.fan_out(published, users, slice_rows=size).collect())) == want
    assert Z.fan_out(published.limit(0), users).count() == 0


def test_fan_out_deals_the_users_of_one_file_to_tasks(spark):
    users = spark.range(400).selectExpr("id AS user_id", "true AS active", "true AS wants_mail").coalesce(1)
    published = spark.createDataFrame([(k, -1) for k in range(50)], "article long, author long")
    mails = Z.fan_out(published, users, task_mails=2_000)
    parts = [r["count"] for r in mails.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 20_000 == mails.distinct().count() and max(parts) <= 4_000
