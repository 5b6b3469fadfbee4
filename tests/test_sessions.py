"""Provenance of positions: the stream over several batches against the batch, and both against a walk over the rows."""

from __future__ import annotations

import random

from strandline.streaming import sessions

SCHEMA = "session string, ord long, chrom string, pos long, start long, end long, label string"


def rows(n=240):
    rnd = random.Random(5)
    out = []
    for i in range(n):
        p = rnd.randint(0, 40)
        asks = rnd.random() < 0.4
        span = rnd.random() < 0.8
        out.append((rnd.choice("st"), i, rnd.choice(["1", "2"]), p if rnd.random() < 0.7 or not asks else None, p - 3 if asks and span else None, p + 3 if asks and span else None, None if asks else f"l{i}"))
    return out


def walked(data):
    seen, out = {}, []
    for s, o, c, p, a, b, label in data:
        own = seen.setdefault(s, {})
        if label is not None:
            own[c, p] = (own[c, p][0] if (c, p) in own else o, label)
            continue
        hit = (p, own[c, p][1]) if (c, p) in own else None
        if hit is None and a is not None:
            inside = [(t, q, text) for (k, q), (t, text) in own.items() if k == c and a <= q <= b]
            hit = min(inside)[1:] if inside else None
        out.append((s, o, sessions.KNOWN if hit else sessions.UNKNOWN, *(hit or (None, None))))
    return sorted(out)


def test_batch(spark):
    data = rows()
    got = sorted(map(tuple, sessions.answered(spark.createDataFrame(data, SCHEMA)).collect()))
    assert got == walked(data) and {r[2] for r in got} == {sessions.KNOWN, sessions.UNKNOWN}
    assert sessions.answered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_keeps_state_between_batches(spark, tmp_path):
    data = rows()
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):
            spark.createDataFrame(data[k * 80 : (k + 1) * 80], SCHEMA).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
            stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
            q = sessions.answered_stream(stream, None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(200)
    finally:
        spark.conf.set(key, before)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("session", "ord", "source", "at", "label").collect())) == walked(data)
