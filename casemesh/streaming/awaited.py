"""Requests that wait for their transcripts: state per request, timers, each decided once.

Requests are kept in buckets by the hash of their id, each with one timer: that of its first
request whose time ends. A bucket is read and written as a whole.

Events are ``complaint_id, kind, text, media_path, at``: a ``request``, typed or with a media
file, or the ``transcript`` of one. They arrive in any order and more than once.

- A request with a usable text is decided at once. One without waits, and takes the earliest
  transcript that lies no more than ``wait`` from it, before or after.
- When the watermark has passed ``wait`` and no transcript has come, the request ends without
  a text, which the rules call pending.
- A request that was sent again within ``wait`` is not decided again. After that the state
  of its id is dropped: what is held grows with the requests of that span, not with the stream.

Where events are no later than the watermark allows, the decisions do not depend on the order
in which they came, and equal those of ``awaited_batch`` over all events; only the time of a
typed request that was sent again is that of the one which came first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casemesh.functions import text as tx

REQUEST, TRANSCRIPT = "request", "transcript"
EVENT = ["complaint_id", "kind", "text", "media_path", "at_ms"]
DECISION = ["complaint_id", "complaint_text", "media_path", "at_ms"]
RESULT = "complaint_id string, complaint_text string, media_path string, at_ms long"
# What is known of the ids of a bucket, each a transcript or a request that waits for the other,
# or a decision.
STATE = (
    "ids array<string>, stages array<string>, texts array<string>, paths array<string>, "
    "ats array<long>, dues array<long>"
)
HEARD, WAITING, DECIDED = "heard", "waiting", "decided"
# A call per id costs milliseconds, so ids share a call and a state by their hash.
BUCKETS = 4096


def usable(events: DataFrame) -> DataFrame:
    """The columns that matter, and blank texts as none; transcripts without a text go."""
    said = F.when(~tx.is_blank(F.col("text")), F.col("text"))
    plain = events.select(
        F.col("complaint_id").cast("string").alias("complaint_id"), "kind",
        said.alias("text"), "media_path", "at",
    )
    asked, heard = F.col("kind") == REQUEST, F.col("kind") == TRANSCRIPT
    known = F.col("complaint_id").isNotNull() & (asked | (heard & F.col("text").isNotNull()))
    # One condition that needs the time too, so that it is not moved below the watermark.
    return plain.where(F.coalesce(F.when(F.col("at").isNotNull(), known), F.lit(False)))


class Known(NamedTuple):
    """What is known of an id, and the event time at which that ends."""

    stage: str
    text: str | None
    path: str | None
    at: int
    due: int


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _decide(known: Known | None, asked: list, heard: list, wait: int, watermark: int):
    """What is known of one id after its events, and the text it is decided with, if it is now.

    ``asked`` are the ``(at, text, path)`` of its requests, ``heard`` the ``(at, text)`` of
    transcripts.
    """

    def remember(stage, text, path, at) -> Known:
        # The watermark itself is the earliest moment a timer may be set to.
        return Known(stage, text, path, at, max(at + wait, watermark + 1))

    stage = known.stage if known else None
    if stage == DECIDED:
        return remember(DECIDED, known.text, known.path, known.at), False, None
    if stage == HEARD:
        heard = [*heard, (known.at, known.text)]
    if stage == WAITING:
        when, said, path = known.at, None, known.path
    elif asked:
        when, said, path = min(asked, key=lambda row: (row[0], row[1] is None, row[1] or ""))
    else:
        at, text = min(heard)
        return remember(HEARD, text, None, at), False, None
    if said is None:
        near = [(a, t) for a, t in heard if abs(a - when) <= wait]
        said = min(near)[1] if near else None
    if said is None:
        return remember(WAITING, None, path, when), False, None
    return remember(DECIDED, None, path, when), True, said


def _decide_bucket(frames: Iterator[pd.DataFrame], state: GroupState, wait: int):
    """Decides the ids of a bucket that have events, and ends those whose time is over."""
    watermark = state.getCurrentWatermarkMs()
    held = {row[0]: Known(*row[1:]) for row in zip(*state.get)} if state.exists else {}
    asked, heard = defaultdict(list), defaultdict(list)
    if not state.hasTimedOut:
        for frame in frames:
            for name, kind, text, path, at in zip(*(frame[c].tolist() for c in EVENT)):
                if kind == REQUEST:
                    asked[name].append((at, _text(text), _text(path)))
                else:
                    heard[name].append((at, text))
    rows = []
    for name, known in list(held.items()):
        if known.due < watermark and name not in asked and name not in heard:
            if known.stage == WAITING:
                rows.append((name, None, known.path, known.at))
            del held[name]
    for name in dict.fromkeys([*asked, *heard]):
        known, decided, text = _decide(held.get(name), asked[name], heard[name], wait, watermark)
        held[name] = known
        if decided:
            rows.append((name, text, known.path, known.at))
    if held:
        state.update(tuple(list(column) for column in zip(*((name, *k) for name, k in held.items()))))
        state.setTimeoutTimestamp(max(min(k.due for k in held.values()), watermark + 1))
    elif state.exists:
        state.remove()
    if rows:
        yield pd.DataFrame(rows, columns=DECISION).astype({"at_ms": "int64"})


def awaited_requests(
    events: DataFrame, wait_seconds: int, lateness: str = "10 minutes", buckets: int = BUCKETS
) -> DataFrame:
    """``complaint_id, complaint_text, media_path, requested_at`` of a stream of events, each
    request once. ``lateness`` is how far behind the latest event others may come; ``at`` is a
    timestamp, and events of any other kind only move the clock. ``buckets`` must stay the same
    as long as a checkpoint is used."""
    wait = wait_seconds * 1000

    def decide(key, frames, state):
        yield from _decide_bucket(frames, state, wait)

    # The time itself stays too, as it is what late events are known by.
    known = usable(events.withWatermark("at", lateness)).select(
        F.pmod(F.xxhash64("complaint_id"), F.lit(buckets)).alias("bucket"),
        "*", F.unix_millis("at").alias("at_ms"),
    )
    decided = known.groupBy("bucket").applyInPandasWithState(
        decide, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return decided.select(*DECISION[:3], F.timestamp_millis("at_ms").alias("requested_at"))


def awaited_batch(events: DataFrame, wait_seconds: int, until: Column | None = None) -> DataFrame:
    """The same decisions over all events at once, for ids whose events lie within the wait.

    Requests that still waited at ``until``, a timestamp, are left out.
    """
    rows = usable(events)
    asked = F.col("kind") == REQUEST
    order = F.struct("at", F.col("text").isNull(), F.coalesce("text", F.lit("")), "text", "media_path")
    per_id = rows.groupBy("complaint_id").agg(
        F.min(F.when(asked, order)).alias("asked"),
        F.array_sort(F.collect_list(F.when(~asked, F.struct("at", "text")))).alias("heard"),
    ).where("asked IS NOT NULL")

    def seconds(c: Column) -> Column:
        return F.unix_micros(c) / 1e6

    near = F.filter(
        "heard", lambda h: F.abs(seconds(h["at"]) - seconds(F.col("asked.at"))) <= wait_seconds
    )
    said = F.coalesce(F.col("asked.text"), F.get(near, F.lit(0))["text"])
    decided = per_id.select(
        "complaint_id", said.alias("complaint_text"), F.col("asked.media_path").alias("media_path"),
        F.col("asked.at").alias("requested_at"),
    )
    if until is None:
        return decided
    over = seconds(F.col("requested_at")) + wait_seconds < seconds(until)
    return decided.where(F.col("complaint_text").isNotNull() | over)
