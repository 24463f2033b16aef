"""Sessions with deadlines and captures that expire, cut into batches in several ways."""

from datetime import datetime, timedelta

import pytest

from sparklode.sources import shared
from sparklode.streaming import sessions

T0 = datetime(2024, 1, 1)


def _run(spark, through, schema, rows, cuts):
    at = shared.fresh(spark, "in")
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    table = shared.fresh(spark, "out")
    q = sessions.written(through(stream), table, shared.fresh(spark, "checkpoint"), {"availableNow": True})
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.parquet(table).collect()


@pytest.mark.parametrize("cuts", [[], [3, 4, 9]])
def test_sessions(spark, cuts):
    steps = [
        (0, "match", "r1", None), (1, "match", "r2", None), (2, "start", "m1", 600.0), (3, "match", "r1", None), (4, "extend", None, 60.0), (20, "match", "r1", None),
        (21, "end", None, None), (22, "match", "r1", None), (23, "enable", None, None), (24, "match", "r3", None), (25, "match", None, None), (26, "extend", None, 60.0), (27, "start", "m2", None),
        (28, "extend", None, 60.0), (29, "start", "m3", 60.0), (90, "match", None, None),
    ]
    rows = [("o", T0 + timedelta(minutes=m), i, kind, name, s) for i, (m, kind, name, s) in enumerate(steps)]
    rows.append(("quiet", T0, 99, "start", "q", 120.0))
    rows = sorted(rows[:3] + rows[-1:], key=lambda r: r[1]) + rows[3:-1]
    got = sorted((r["owner"], (r["ts"] - T0).total_seconds() / 60, r["action"], r["source"], r["id"], r["reason"]) for r in _run(spark, sessions.sessions, sessions.COMMAND, rows, cuts))
    assert got == sorted([
        ("o", 0.0, "start", "trigger", "r1", None), ("o", 1.0, "replace", "trigger", "r2", None), ("o", 2.0, "replace", "manual", "m1", None), ("o", 4.0, "extend", "manual", "m1", None),
        ("o", 13.0, "end", "manual", "m1", "deadline"), ("o", 20.0, "start", "trigger", "r1", None), ("o", 21.0, "end", "trigger", "r1", "requested"), ("o", 24.0, "start", "trigger", "r3", None),
        ("o", 25.0, "end", "trigger", "r3", "condition"), ("o", 27.0, "start", "manual", "m2", None), ("o", 29.0, "replace", "manual", "m3", None), ("o", 30.0, "end", "manual", "m3", "deadline"),
        ("quiet", 0.0, "start", "manual", "q", None), ("quiet", 2.0, "end", "manual", "q", "deadline"),
    ])


@pytest.mark.parametrize("cuts", [[], [2, 5]])
def test_captures_expire(spark, cuts):
    rows = [("a", T0), ("b", T0), ("a", T0 + timedelta(minutes=5)), ("a", T0 + timedelta(minutes=15)), ("c", T0 + timedelta(minutes=15)), ("a", T0 + timedelta(minutes=40)), ("d", T0 + timedelta(minutes=45))]
    got = sorted((r["content_hash"], (r["last_at"] - r["first_at"]).total_seconds() / 60, r["copies"]) for r in _run(spark, lambda s: sessions.expired(s, 600_000, 2), "content_hash string, ts timestamp", rows, cuts))
    assert got == [("a", 15.0, 3), ("b", 0.0, 1), ("c", 0.0, 1)]  # the second "a" and "d" still live
