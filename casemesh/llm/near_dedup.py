"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Every text becomes its set of word shingles, a MinHash signature and a fingerprint of
   the set. Texts with equal sets are collapsed to the smallest id before anything else.
2. Signatures are cut into bands; texts that agree in a band are candidates. A bucket
   compares its members with its most central one, the member that agrees with others most
   often over all bands, so a bucket of n texts costs n rows.
3. Candidates are compared signature batch by signature batch. After m values with c
   agreements the posterior of the similarity under a uniform prior is Beta(c + 1, m - c + 1);
   a pair is dropped as soon as it reaches the threshold with less than ``miss``.
4. Survivors are verified on their full sets, and links join into components.
5. No candidate link may be lost to step 2: members that are not in the component of their
   center are compared with all others of that center, in blocks of bounded size. Banded
   candidates of different components are pruned and verified as above inside the blocks,
   and only links that join components become rows.

Defined cases: null or wordless texts have no shingles and no link; rows without id take no
part and are kept; rows that repeat an id are one document and all come back; where their
texts differ, the smallest set (by size, then fingerprint) is the one that is compared; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.llm.learning import settled, worker_state
from casemesh.llm.words import FOLDED_VALUES, constants, shingle_sets, slices, words
from casemesh.operators.duplicates import duplicate_clusters
from casemesh.operators.joins import join_unique
from casemesh.session import few_tasks, materialize, materialize_counted, small_batches

VALUE_BYTES = 4
# So many rows are enough for a Python task: pairs of signatures, pairs of sets, texts, pairs of blocks.
TASK_SIGNATURES = 1 << 14
TASK_SETS = 1 << 12
TASK_TEXTS = 1 << 12
TASK_BLOCKS = 1 << 6


class NearDedup(NamedTuple):
    """``similarity`` is a share in hundredths. ``bands`` of ``rows`` values each;
    ``batch`` values are compared between two looks at the posterior."""

    width: int = 5
    similarity: int = 80
    bands: int = 24
    rows: int = 6
    batch: int = 24
    miss: float = 1e-7
    block: int = 128

    @property
    def values(self) -> int:
        return self.bands * self.rows


def signature(shingle_set: np.ndarray, factors: np.ndarray) -> bytes:
    """The upper halves of the smallest products with each factor."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(shingle_set), 1024):
        part = shingle_set[low : low + 1024, None] * factors
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def fingerprint(shingle_set: np.ndarray) -> tuple[int, int]:
    """Two numbers that, with the size, tell a set from others."""
    mixed = shingle_set * (shingle_set | np.uint64(1))
    return (
        int(shingle_set.sum(dtype=np.uint64).view(np.int64)),
        int(np.bitwise_xor.reduce(mixed).view(np.int64)),
    )


def least_agreements(config: NearDedup) -> list[tuple[int, int]]:
    """``(m, c)``: fewer than ``c`` agreements among the first ``m`` values drop a pair.

    The posterior Beta(c + 1, m - c + 1) lies above t with the chance of at most c
    successes in m + 1 trials of chance t.
    """
    t = config.similarity / 100
    table = []
    for m in range(config.batch, config.values + 1, config.batch):
        below, c = 0.0, 0
        while c <= m:
            below += comb(m + 1, c) * t**c * (1 - t) ** (m + 1 - c)
            if below >= config.miss:
                break
            c += 1
        table.append((m, c))
    return table


def plausible(left: np.ndarray, right: np.ndarray, config: NearDedup) -> np.ndarray:
    """Which rows of two signature arrays survive all looks at the posterior."""
    alive = np.arange(len(left))
    agreed = np.zeros(len(left), dtype=np.int64)
    seen = 0
    for m, c in least_agreements(config):
        same = (left[alive, seen:m] == right[alive, seen:m]).sum(axis=1)
        agreed = agreed + same
        stay = agreed >= c
        alive, agreed, seen = alive[stay], agreed[stay], m
    return alive


def _signatures(column: pa.Array, values: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, values)


def sketch(docs: DataFrame, config: NearDedup) -> DataFrame:
    """``doc_id, n_shingles, set_sum, set_mix, signature``; one row per input row."""
    factors = constants(config.values, 3)

    def run(batches):
        worker_state("near_dedup")
        for batch in batches:
            ids, out = batch.column(0), []
            for part in slices(batch.column(1)):
                found = words(part.data, part.bounds, values=FOLDED_VALUES)
                for own in shingle_sets(found, config.width):
                    if not len(own):
                        out.append((0, None, None, None))
                        continue
                    out.append((len(own), *fingerprint(own), signature(own, factors)))
            counts, sums, mixes, signs = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(counts, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(mixes, pa.int64()),
                    pa.array(signs, pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_sum", "set_mix", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, set_sum long, set_mix long, signature binary"
    )


def shingle_table(docs: DataFrame, config: NearDedup) -> DataFrame:
    """``doc_id, n, total, mixed, shingles``: the sorted set as packed 64-bit values, and
    what tells it apart from others."""

    def run(batches):
        worker_state("near_dedup")
        for batch in batches:
            ids = batch.column(0)
            for part in slices(batch.column(1)):
                found = words(part.data, part.bounds, values=FOLDED_VALUES)
                sets = list(shingle_sets(found, config.width))
                marks = [fingerprint(own) for own in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.low, part.high - part.low),
                        pa.array([len(own) for own in sets], pa.int64()),
                        pa.array([total for total, _ in marks], pa.int64()),
                        pa.array([mixed for _, mixed in marks], pa.int64()),
                        pa.array([own.tobytes() for own in sets], pa.binary()),
                    ],
                    ["doc_id", "n", "total", "mixed", "shingles"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, total long, mixed long, shingles binary")


def _prune(pairs: DataFrame, firsts: DataFrame, config: NearDedup) -> DataFrame:
    """The pairs ``a, b`` whose signatures leave the threshold plausible."""
    signs = firsts.select("a", "signature")
    both = pairs.join(signs.withColumnRenamed("signature", "left"), "a").join(
        signs.select(F.col("a").alias("b"), F.col("signature").alias("right")), "b"
    )

    def run(batches):
        worker_state("near_dedup")
        for batch in batches:
            left = _signatures(batch.column(2), config.values)
            right = _signatures(batch.column(3), config.values)
            keep = pa.array(plausible(left, right, config))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"]
            )

    both = few_tasks(both.select("a", "b", "left", "right"), pairs.count(), TASK_SIGNATURES)
    return both.mapInArrow(run, "a long, b long")


def linked(one: np.ndarray, two: np.ndarray, similarity: int) -> bool:
    """The verdict on two full sets."""
    low, high = sorted((len(one), len(two)))
    if 100 * low < similarity * high:
        return False
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= similarity * (len(one) + len(two) - common)


def _set(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint64)


def _verify(pairs: DataFrame, rows: int, sets: DataFrame, config: NearDedup) -> DataFrame:
    """The pairs, ``rows`` of them, whose full sets reach the threshold."""
    both = pairs.join(
        sets.select("a", F.col("shingles").alias("left")), "a"
    ).join(sets.select(F.col("a").alias("b"), F.col("shingles").alias("right")), "b")

    def run(batches):
        worker_state("near_dedup")
        for batch in batches:
            keep = pa.array(
                [
                    linked(_set(left), _set(right), config.similarity)
                    for left, right in zip(batch.column(2), batch.column(3))
                ],
                pa.bool_(),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"]
            )

    both = few_tasks(both.select("a", "b", "left", "right"), rows, TASK_SETS)
    return both.mapInArrow(run, "a long, b long")


def _bands(firsts: DataFrame, config: NearDedup) -> DataFrame:
    """``a, band``: one row per band, its number mixed into the value."""
    width = config.rows * VALUE_BYTES
    number = F.sequence(F.lit(0), F.lit(config.bands - 1))
    return firsts.select("a", F.explode(number).alias("n"), "signature").select(
        "a",
        F.xxhash64(
            "n", F.substring("signature", F.col("n") * width + 1, F.lit(width))
        ).alias("band"),
    )


def _centers(shared: DataFrame) -> DataFrame:
    """``a, b``: every member of a bucket but its center, with the center.

    ``shared`` has ``a, band, members``. A text that many copies were made from agrees with
    them in most bands, and so has the largest sum of members; ties go to the smallest id.
    """
    degree = shared.groupBy("a").agg(F.sum("members").alias("degree"))
    rank = F.struct(F.col("degree"), -F.col("a"))
    centers = shared.join(degree, "a").groupBy("band").agg(F.max_by("a", rank).alias("b"))
    centers = materialize(centers, "near-centers")
    return shared.join(centers, "band").where("a <> b").select("a", "b").distinct()


def _blocks(pairs: DataFrame, components: DataFrame, config: NearDedup) -> DataFrame:
    """``b, outside, block, blocks, a, component``: the members of every center that has a
    member outside its component and more than one member.

    ``outside`` members are those not in the component of the center. They, and the others,
    are dealt into blocks of about ``config.block`` members each.
    """
    def owned(rows: DataFrame, key: str) -> DataFrame:
        named = components.select(F.col("id").alias(key), F.col("cluster").alias(f"of_{key}"))
        return rows.join(named, key, "left").withColumn(f"of_{key}", F.coalesce(f"of_{key}", key))

    members = owned(owned(pairs, "a"), "b").select(
        "b", "a", F.col("of_a").alias("component"), (F.col("of_a") != F.col("of_b")).alias("outside")
    )
    members = materialize(members, "near-members")
    outside = F.sum(F.col("outside").cast("long"))
    sizes = (
        members.groupBy("b")
        .agg(outside.alias("out"), F.count(F.lit(1)).alias("all"))
        .where((F.col("out") > 0) & (F.col("all") > 1))
    )
    count = F.when(F.col("outside"), F.col("out")).otherwise(F.col("all") - F.col("out"))
    return (
        members.join(materialize(sizes, "near-split"), "b")
        .withColumn("blocks", F.ceil(count / config.block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        .withColumn("out_blocks", F.ceil(F.col("out") / config.block).cast("int"))
        .select("b", "outside", "block", "out_blocks", "a", "component")
    )


def _across(members: DataFrame, firsts: DataFrame, sets: DataFrame, config: NearDedup) -> DataFrame:
    """Links ``a, b`` between members of different components, enough to join them."""
    payload = F.struct("a", "component", "signature", "shingles")
    # Blocks outside meet each other once, and every block inside.
    first = F.when(F.col("outside"), F.col("block")).otherwise(F.lit(0))
    blocks, seen = materialize_counted(
        members.join(firsts.select("a", "signature"), "a")
        .join(sets, "a")
        .groupBy("b", "outside", "block", "out_blocks")
        .agg(F.collect_list(payload).alias("members")),
        "near-blocks",
        met=F.sum(F.col("out_blocks") - first),
    )
    left = blocks.select(
        "b",
        F.explode(F.sequence(first, F.col("out_blocks") - 1)).alias("other"),
        F.col("members").alias("left"),
    )
    right = blocks.where("outside").select(
        "b", F.col("block").alias("other"), F.col("members").alias("right")
    )
    both = left.join(right, ["b", "other"]).select("left", "right")
    both = few_tasks(both, int(seen["met"] or 0), TASK_BLOCKS)

    def unpack(members):
        return (
            members.field("a").to_numpy(zero_copy_only=False),
            members.field("component").to_numpy(zero_copy_only=False),
            _signatures(members.field("signature"), config.values),
            [_set(value) for value in members.field("shingles")],
        )

    def run(batches):
        worker_state("near_dedup")
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                found += links_between(
                    unpack(batch.column(0)[row].values), unpack(batch.column(1)[row].values), config
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([pair[side] for pair in found], pa.int64()) for side in (0, 1)],
                ["a", "b"],
            )

    return both.mapInArrow(run, "a long, b long").distinct()


def links_between(left, right, config: NearDedup) -> list[tuple[int, int]]:
    """Links between two blocks that join components not joined by a link before."""
    ids, components, signs, sets = left
    other_ids, other_components, other_signs, other_sets = right
    banded = other_signs.reshape(len(other_ids), config.bands, config.rows)
    joined: dict[int, int] = {}

    def root(component: int) -> int:
        while component in joined:
            component = joined[component]
        return component

    found = []
    for i in range(len(ids)):
        mine = signs[i].reshape(config.bands, config.rows)
        candidates = np.flatnonzero(
            (other_components != components[i]) & (banded == mine).all(axis=2).any(axis=1)
        )
        same = np.broadcast_to(signs[i], (len(candidates), config.values))
        for j in candidates[plausible(same, other_signs[candidates], config)]:
            one, two = root(int(components[i])), root(int(other_components[j]))
            if one != two and linked(sets[i], other_sets[j], config.similarity):
                joined[max(one, two)] = min(one, two)
                pair = int(ids[i]), int(other_ids[j])
                found.append((max(pair), min(pair)))
    return found


def near_duplicates(docs: DataFrame, config: NearDedup = NearDedup()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest id linked to the row, directly or through others.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # A set is one column, so that joins can be salted where many texts share it.
    whole = F.when(F.col("n_shingles") > 0, F.struct("n_shingles", "set_sum", "set_mix"))
    with small_batches(spark):
        sketched = materialize(sketch(docs, config), "near-sketches").withColumn("whole", whole)
    several = settled(spark, "near-several", lambda: _several(sketched))
    if several.isEmpty():
        own = sketched
    else:
        sketched = join_unique(sketched, several, "doc_id")
        own = sketched.where("chosen IS NULL OR chosen = whole")
        sketched = sketched.withColumn("whole", F.coalesce("chosen", "whole"))
    named = settled(spark, "near-classes", lambda: _classes(docs, own, config))
    rows = sketched.select("doc_id", "n_shingles", "whole")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        join_unique(rows, named, "whole")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _several(sketched: DataFrame) -> DataFrame:
    """``doc_id, chosen``: the set that counts for an id whose rows differ, the smallest."""
    return (
        sketched.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(
            F.min("whole").alias("chosen"),
            F.max("whole").alias("largest"),
            F.count("whole").alias("filled"),
            F.count(F.lit(1)).alias("rows"),
        )
        .where("chosen <> largest OR (filled > 0 AND filled < rows)")
        .select("doc_id", "chosen")
    )


def _classes(docs: DataFrame, sketched: DataFrame, config: NearDedup) -> DataFrame:
    """``whole, component_id`` of each different set."""
    spark = docs.sparkSession
    firsts, texts = materialize_counted(
        sketched.where("whole IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("whole")
        .agg(F.min("doc_id").alias("a"), F.first("signature").alias("signature")),
        "near-firsts",
    )
    bands = _bands(firsts, config)
    buckets = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialize(bands.join(buckets, "band").select("a", "band", "members"), "near-shared")
    pairs = settled(spark, "near-pairs", lambda: _centers(shared))
    close, left = materialize_counted(_prune(pairs, firsts, config), "near-plausible")
    banded = shared.select(F.col("a").alias("doc_id")).distinct()
    shared_texts = few_tasks(docs.join(banded, "doc_id", "left_semi"), texts["rows"], TASK_TEXTS)
    # Written one per id, so that joins with them can be split where a center is hot.
    sets = settled(
        spark,
        "near-sets",
        lambda: materialize(shingle_table(shared_texts, config), "near-all-sets")
        .where("n > 0")
        .groupBy("doc_id")
        .agg(F.min_by("shingles", F.struct("n", "total", "mixed")).alias("shingles"))
        .withColumnRenamed("doc_id", "a"),
    )
    links = materialize(_verify(close, left["rows"], sets, config), "near-links")
    components = settled(spark, "near-components", lambda: duplicate_clusters(links))
    members = materialize(_blocks(pairs, components, config), "near-outside")
    more = settled(spark, "near-more-links", lambda: _across(members, firsts, sets, config))
    if not more.isEmpty():
        components = duplicate_clusters(links.unionByName(more))
    return firsts.join(components, F.col("a") == F.col("id"), "left").select(
        "whole", F.coalesce("cluster", "a").alias("component_id")
    )
