"""What the operators share: the split of the labels, bounded samples, names, worker state."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import types
import uuid
from collections.abc import Callable

from pyspark import SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.session import scratch_path, scratch_scope

# Fixed values of the split: rows whose id gives this remainder never teach.
FOLDS = 3
HELD_OUT_FOLD = 1


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is in the fold that never teaches. Rows without id are in no fold."""
    return F.coalesce(fold(doc_id) == HELD_OUT_FOLD, F.lit(False))


def teaches(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) != HELD_OUT_FOLD, F.lit(False))


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows of ``df`` at most, chosen by a hash of ``keys``: the same on
    every run, and an even share of every part of the table."""
    total = df.count()
    if total <= rows:
        return df
    scale = 1 << 30
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(scale)) < int(scale * rows / total))


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is none of ``taken``, whatever their case."""
    used = {c.lower() for c in taken}
    name = f"_{name}"
    while name.lower() in used:
        name += "_"
    return name


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes, as a written table; the tables it made on the way are removed."""
    path = scratch_path(spark, name)
    with scratch_scope(spark):
        rows = build()
        schema = rows.schema
        rows.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, shared by its tasks.

    Functions of this package travel by value, so their own globals start empty in every
    task; what is costly to build again is kept here. Only one operator's state is kept:
    every operator asks for its own, so that a worker which goes on to another stage of a
    pipeline gives the memory of the last one back, to the system too.
    """
    module = sys.modules.setdefault("_casemesh_worker", types.ModuleType("_casemesh_worker"))
    stale = [k for k in vars(module) if k.startswith("state_") and k != f"state_{name}"]
    for other in stale:
        vars(module).pop(other)
    if stale:
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass
    return vars(module).setdefault(f"state_{name}", {})


class Shipped:
    """A value for all tasks, unpacked once per worker.

    It is pickled together with the classes it is made of, so that executors need no
    installation of this package.
    """

    def __init__(self, sc: SparkContext, name: str, value):
        self.name, self.key = name, uuid.uuid4().hex
        self.sent = sc.broadcast(cloudpickle.dumps(value))

    def get(self):
        state = worker_state(self.name)
        if state.get("key") != self.key:
            state.clear()
            state.update(key=self.key, value=pickle.loads(self.sent.value))
        return state["value"]
