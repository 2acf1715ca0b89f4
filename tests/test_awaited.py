import datetime
import random

import pytest
from pyspark.sql import functions as F

from casemesh.streaming.awaited import awaited_batch, awaited_requests

SCHEMA = "complaint_id string, kind string, text string, media_path string, at timestamp"
START = datetime.datetime(2024, 1, 1, 12)


def event(name, kind, seconds, text=None, path=None):
    return (name, kind, text, path, START + datetime.timedelta(seconds=seconds))


END = event("end", "request", 10_000_000, "end")


def streamed(spark, folder, batches, wait, lateness="600 seconds"):
    source, out = f"{folder}/in", f"{folder}/out"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/{n:03d}")
        query = (
            awaited_requests(
                spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source), wait, lateness
            )
            .writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    rows = spark.read.parquet(out).where("complaint_id <> 'end'").collect()
    return sorted((r["complaint_id"], r["complaint_text"], r["media_path"]) for r in rows)


def in_batch(spark, events, wait):
    rows = awaited_batch(spark.createDataFrame(events, SCHEMA), wait).where("complaint_id <> 'end'").collect()
    return sorted((r["complaint_id"], r["complaint_text"], r["media_path"]) for r in rows)


def key(row):
    return tuple(map(str, row))


CASES = [
    event("typed", "request", 0, "burst pipe"), event("typed", "request", 5, "burst pipe"),
    event("late", "request", 10, None, "a.wav"), event("late", "transcript", 60, "it says smoke"),
    event("early", "transcript", 20, "came first"), event("early", "request", 30, "  ", "b.wav"),
    event("never", "request", 15, None, "c.wav"), event("far", "request", 0, None, "d.wav"),
    event("far", "transcript", 500, "too far"), event("two", "request", 0, None, "e.wav"),
    event("two", "transcript", 40, "second"), event("two", "transcript", 30, "first"),
    event("odd", "transcript", 10, " "), event("odd", "noise", 10, "x"), event(None, "request", 1, "x"),
]


def test_each_request_is_decided_once(spark):
    got = {r[0]: r[1] for r in in_batch(spark, CASES, 120)}
    assert got == {
        "typed": "burst pipe", "late": "it says smoke", "early": "came first", "never": None,
        "far": None, "two": "first",
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_equals_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = list(CASES)
    rng.shuffle(events)
    # Two transcripts of one request arrive together; which comes first is not told otherwise.
    pair = [e for e in events if e[0] == "two"]
    events = [e for e in events if e[0] != "two"]
    batches = [events[:4], events[4:9] + pair, events[9:], [END]]
    got = streamed(spark, str(tmp_path), batches, 120)
    assert sorted(got, key=key) == sorted(in_batch(spark, CASES, 120), key=key)


def test_requests_still_waiting_are_left_out_until_their_time(spark):
    events = spark.createDataFrame(CASES, SCHEMA)
    until = F.lit(START + datetime.timedelta(seconds=130))
    names = {r["complaint_id"] for r in awaited_batch(events, 120, until).collect()}
    assert names == {"typed", "late", "early", "two", "far"}
    assert awaited_batch(events.limit(0), 120).count() == 0


def test_ids_share_states_and_still_end_by_their_own_time(spark, tmp_path):
    """The calls of a batch grow with the buckets, not with the ids."""
    events = [event(f"n{n}", "request", 30 * n, None, f"{n}.wav") for n in range(40)]
    events += [event(f"n{n}", "transcript", 30 * n + 100, f"said {n}") for n in range(0, 40, 4)]
    source, out, held = f"{tmp_path}/in", f"{tmp_path}/out", []
    for n, rows in enumerate([events[:20], events[20:], [event("clock", "clock", 1500)], [END]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/{n:03d}")
        arriving = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source)
        query = (
            awaited_requests(arriving, 120, "600 seconds", buckets=2)
            .writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        held.append((query.recentProgress[0].stateOperators[0].numRowsTotal, spark.read.parquet(out).count()))
    assert max(rows for rows, _ in held) <= 2
    # The clock is at 1180, then at 1500: those end that were asked 600 + 120 seconds before.
    ended = [sum(n % 4 != 0 and 30 * n < clock - 720 for n in range(40)) for clock in (1180, 1500)]
    assert [decided for _, decided in held[1:3]] == [10 + n for n in ended]
    got = {(r["complaint_id"], r["complaint_text"]) for r in spark.read.parquet(out).collect()}
    assert got == {(f"n{n}", f"said {n}" if n % 4 == 0 else None) for n in range(40)} | {("end", "end")}
