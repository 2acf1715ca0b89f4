"""Fuzzy duplicate lines: MinHash bands over character shingles, with column functions only.

A line is its text between line ends, without blanks around it. Its shingles are the pieces
of ``width`` characters at every position, or the line itself where it is shorter. So every
character counts, and an edit changes no shingle that does not hold it, with or without
spaces. Lines are compared by the Jaccard similarity of their full sets of shingles.

1. Equal lines are grouped by two hashes; the first in order of document and line stands
   for all.
2. Candidates come from a sketch: the pieces of up to ``width`` characters that begin where
   a word begins, and at every position that has ``width`` characters without a blank
   before it. Which pieces these are depends on the characters before them only, so an edit
   moves none but its neighbours. Their hashes are sorted around a circle, which is a random
   order of them. A band is the ``rows`` hashes that follow one of ``bands`` fixed points,
   so two lines agree in a band as often as in that many values of a MinHash signature;
   small sketches use a band behind each hash.
3. In each band the lines are compared with its most central one, the line that meets others
   most often over all bands, on their full sets of shingles. No link may be lost to that:
   lines that are not in the component of their center meet all others of that center that
   share a band with them, in blocks of bounded size, and are linked to one line of each other component in which
   a similar one is found.
4. Links join into components by large-star and small-star rounds. The first line of each
   component, by document and line, stays.

Measured against all pairs of full sets, lines that are linked at 0.8 get the same component
in at least 95 of 100 cases (``tests/llm/test_line_recall.py``; edited prose, and scripts
without spaces); from 0.9 on hardly any is missed. A line is never dropped on the sketch
alone: every link is verified.

Defined cases: null texts have no lines; blank lines are no duplicates and always stay; rows
without id take no part and come back as they are; rows that repeat an id are one document;
other columns come back unchanged whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh.llm.learning import fresh, settled
from casemesh.operators.duplicates import duplicate_clusters
from casemesh.operators.joins import join_unique
from casemesh.session import materialize, materialize_counted

LINE_END = "\n"
BLANKS = " \t\r\f\v"
# So many keys of eight bytes go to every executor, and the texts stay where they are.
SMALL_ROWS = 1 << 20


class LineDedup(NamedTuple):
    """``similarity`` is a share in hundredths; ``bands`` is a power of two."""

    width: int = 12
    similarity: int = 80
    bands: int = 8
    rows: int = 4
    block: int = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: all lines that are not blank."""
    cut = F.posexplode(F.split(F.col("text"), LINE_END, -1)).alias("line_no", "raw")
    return (
        docs.where("doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), cut)
        .select("doc_id", "line_no", F.trim("raw", F.lit(BLANKS)).alias("line"))
        .where("line <> ''")
    )


def shingle_hashes(line: Column, config: LineDedup) -> Column:
    """The hashes of the distinct shingles of a line."""
    short = f"|^.{{1,{config.width - 1}}}\\z" if config.width > 1 else ""
    pattern = rf"(?s)(?=(.{{{config.width}}}{short}))."
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(found, lambda s: F.xxhash64(s)))


def sketch_hashes(line: Column, config: LineDedup) -> Column:
    """The sorted hashes of the pieces at word starts and deep inside runs without blanks."""
    width = config.width
    pattern = rf"(?s)(?=(.{{1,{width}}}))(?:(?<=\S{{{width}}})\S|\S{{1,{width}}})\s*"
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(found, lambda s: F.xxhash64(s))))


def with_bands(sketched: DataFrame, config: LineDedup) -> DataFrame:
    """``sketched`` with ``bands`` in place of its column ``own``, the hashes of a sketch.

    A band is the hashes behind a fixed point of the circle. One step a projection: a column
    that is used more than once is computed once, and all but small sketches stay out of
    lambdas.
    """
    step = (1 << 64) // config.bands
    points = [F.lit(n * step - (1 << 63)) for n in range(config.bands)]
    keep = [c for c in sketched.columns if c != "own"]
    # The points are sorted in with the hashes, so their places tell what follows them.
    ringed = sketched.select(
        *keep,
        F.size("own").alias("size"),
        F.concat("own", F.slice("own", 1, config.rows - 1)).alias("ring"),
        F.sort_array(F.concat("own", F.array(*points))).alias("mixed"),
    )
    places = [(F.array_position("mixed", p).cast("int") - n).alias(f"at{n}") for n, p in enumerate(points)]
    placed = ringed.select(*keep, "size", "ring", *places)

    def band(start: Column) -> Column:
        return F.xxhash64(*[F.get("ring", start + (k - 1)) for k in range(config.rows)])

    behind = [
        band(F.when(F.col(f"at{n}") > F.col("size"), 1).otherwise(F.col(f"at{n}")))
        for n in range(config.bands)
    ]
    every = F.transform(F.sequence(F.lit(1), F.col("size")), band)
    bands = F.when(F.col("size") <= config.bands, every).otherwise(F.array_distinct(F.array(*behind)))
    return placed.select(*keep, bands.alias("bands"))


def keyed_lines(docs: DataFrame, config: LineDedup) -> DataFrame:
    """``doc_id, line_no``, two hashes of the line, and its bands: one pass over the texts."""
    sketched = lines_of(docs).select(
        "doc_id",
        "line_no",
        F.xxhash64("line").alias("k1"),
        F.xxhash64(F.lit(7), "line").alias("k2"),
        sketch_hashes(F.col("line"), config).alias("own"),
    )
    return with_bands(sketched, config)


def similar(left: Column, right: Column, similarity: int) -> Column:
    """The verdict on two sets of hashes."""
    common = F.size(F.array_intersect(left, right))
    return 100 * common >= similarity * (F.size(left) + F.size(right) - common)


def _centers(members: DataFrame) -> DataFrame:
    """``a, b``: each line that shares a band with others, with the center of the band.

    ``members`` has ``line, band`` per line of a text, copies included. Bands are counted
    before they are shuffled, and those of one line go; one that many lines share is spread
    over salts when their rows meet its count and its center.
    """
    met = members.groupBy("band").agg(
        F.min("line").alias("low"), F.max("line").alias("high"), F.count(F.lit(1)).alias("lines")
    )
    counted = materialize(met.where("low < high").select("band", "lines"), "line-counts")
    shared, seen = materialize_counted(
        join_unique(members, counted, "band", "inner").distinct(), "line-shared"
    )
    degree = shared.groupBy("line").agg(F.sum("lines").alias("degree"))
    rank = F.struct(F.col("degree"), F.col("line"))
    centers = shared.join(degree, "line").groupBy("band").agg(F.max_by("line", rank).alias("b"))
    centers = materialize(centers, "line-centers")
    return (
        join_unique(shared.select("line", "band"), centers, "band", "inner", left_rows=seen["rows"])
        .where("line <> b")
        .select(F.col("line").alias("a"), "b")
        .distinct()
    )


def _verified(pairs: DataFrame, texts: DataFrame, config: LineDedup) -> DataFrame:
    """The pairs ``a, b`` that are similar. A line moves as its text, an eighth of its set,
    and the set of a center is made once."""
    left = texts.select(F.col("line").alias("a"), F.col("own").alias("left"))
    centers = texts.join(pairs.select(F.col("b").alias("line")).distinct(), "line", "left_semi")
    right = centers.select(F.col("line").alias("b"), shingle_hashes(F.col("own"), config).alias("right"))
    alike = let(
        shingle_hashes(F.col("left"), config),
        lambda own: similar(own, F.col("right"), config.similarity),
    )
    return pairs.join(left, "a").join(materialize(right, "line-center-sets"), "b").where(alike).select("a", "b")


def _across(pairs: DataFrame, components: DataFrame, texts: DataFrame, config: LineDedup) -> DataFrame:
    """Links ``a, b`` of lines to a line of each other component with a similar one."""

    def owned(rows: DataFrame, key: str) -> DataFrame:
        named = components.select(F.col("id").alias(key), F.col("cluster").alias(f"of_{key}"))
        return rows.join(named, key, "left").withColumn(f"of_{key}", F.coalesce(f"of_{key}", key))

    members = materialize(
        owned(owned(pairs, "a"), "b").select(
            "b", "a", F.col("of_a").alias("component"), (F.col("of_a") != F.col("of_b")).alias("outside")
        ),
        "line-members",
    )
    outside = F.sum(F.col("outside").cast("long"))
    sizes = (
        members.groupBy("b")
        .agg(outside.alias("out"), F.count(F.lit(1)).alias("all"))
        .where((F.col("out") > 0) & (F.col("all") > 1))
    )
    count = F.when(F.col("outside"), F.col("out")).otherwise(F.col("all") - F.col("out"))
    dealt = (
        members.join(materialize(sizes, "line-split"), "b")
        .withColumn("block", F.pmod(F.xxhash64("a"), F.ceil(count / config.block)).cast("int"))
        .withColumn("last", (F.ceil(F.col("out") / config.block) - 1).cast("int"))
        .join(texts.select(F.col("line").alias("a"), F.col("own").alias("text"), "bands"), "a")
        .groupBy("b", "outside", "block", "last")
        .agg(F.collect_list(F.struct("component", "a", "bands", "text")).alias("own"))
    )
    blocks = materialize(dealt, "line-blocks")
    # Blocks outside meet each other once, and every block inside.
    first = F.when(F.col("outside"), F.col("block")).otherwise(F.lit(0))
    left = blocks.select(
        "b", "outside", "block", F.explode(F.sequence(first, "last")).alias("other"), F.col("own").alias("left")
    )
    right = blocks.where("outside").select("b", F.col("block").alias("other"), F.col("own").alias("right"))

    def all_bands(members: str) -> Column:
        return F.flatten(F.transform(members, lambda m: m["bands"]))

    def with_sets(members: Column) -> Column:
        return F.transform(
            members,
            lambda m: F.struct(
                m["component"].alias("component"),
                m["a"].alias("a"),
                m["bands"].alias("bands"),
                shingle_hashes(m["text"], config).alias("shingles"),
            ),
        )

    def links(x: Column, others: Column) -> Column:
        def fits(y: Column) -> Column:
            one, two = F.size(x["shingles"]), F.size(y["shingles"])
            sized = 100 * F.least(one, two) >= config.similarity * F.greatest(one, two)
            alike = similar(x["shingles"], y["shingles"], config.similarity)
            banded = F.arrays_overlap(x["bands"], y["bands"])
            return (x["component"] != y["component"]) & sized & banded & alike

        # Of several lines of a component the first of the sorted ones is enough.
        found = F.array_sort(
            F.transform(F.filter(others, fits), lambda y: F.struct(y["component"], y["a"].alias("b")))
        )
        return let(
            found,
            lambda own: F.transform(
                F.filter(
                    own,
                    lambda y, i: (i == 0) | (y["component"] != F.get(own, i - 1)["component"]),
                ),
                lambda y: F.struct(x["a"].alias("a"), y["b"].alias("b")),
            ),
        )

    def linked_in(mine: Column, others: Column) -> Column:
        return let(
            with_sets(others),
            lambda sets: F.flatten(F.transform(with_sets(mine), lambda x: links(x, sets))),
        )

    # Bands that both blocks hold, or that a block compared with itself holds twice. Sets are
    # made of those members alone that have one.
    twice = let(
        F.sort_array(all_bands("left")),
        lambda own: F.filter(own, lambda v, i: (i > 0) & (v == F.get(own, F.greatest(i - 1, F.lit(0))))),
    )
    same = F.col("outside") & (F.col("block") == F.col("other"))
    common = F.when(same, twice).otherwise(F.array_intersect(all_bands("left"), all_bands("right")))

    def having(members: Column) -> Column:
        return F.filter(members, lambda m: F.arrays_overlap(m["bands"], F.col("common")))

    found = linked_in(having(F.col("left")), having(F.col("right")))
    # Few bytes mean much work here: the number of tasks is not left to their size.
    tasks = 2 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.repartition(tasks, "b", "other").join(right, ["b", "other"])
    linked = met.withColumn("common", common).select(F.explode(found).alias("l"))
    return linked.select("l.a", "l.b")


def line_components(docs: DataFrame, config: LineDedup = LineDedup()) -> DataFrame:
    """``doc_id, line_no, first_doc, first_line, kept`` of every line that is not blank.

    ``first_doc`` and ``first_line`` name the line that stays for the component.
    """
    spark = docs.sparkSession
    keyed = materialize(keyed_lines(docs, config), "line-keys")
    classes = settled(spark, "line-classes", lambda: _classes(docs, keyed, config))
    kept = (F.col("doc_id") == F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))
    rows = keyed.select("doc_id", "line_no", F.struct("k1", "k2").alias("key"))
    return join_unique(rows, classes, "key", "inner").select(
        "doc_id", "line_no", "first_doc", "first_line", kept.alias("kept")
    )


def _classes(docs: DataFrame, keyed: DataFrame, config: LineDedup) -> DataFrame:
    """``key, first_doc, first_line``: for each different line the one that stays."""
    firsts = materialize(
        keyed.groupBy("k1", "k2")
        .agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
        .select(F.col("k1").alias("line"), "k2", "first.doc_id", "first.line_no"),
        "line-firsts",
    )
    components = _components(docs, keyed, firsts, config)
    grouped = firsts.join(
        components.select(F.col("id").alias("line"), "cluster"), "line", "left"
    ).withColumn("cluster", F.coalesce("cluster", "line"))
    best = grouped.groupBy("cluster").agg(F.min(F.struct("doc_id", "line_no")).alias("best"))
    return grouped.join(materialize(best, "line-best"), "cluster").select(
        F.struct(F.col("line").alias("k1"), "k2").alias("key"),
        F.col("best.doc_id").alias("first_doc"),
        F.col("best.line_no").alias("first_line"),
    )


def _components(docs: DataFrame, keyed: DataFrame, firsts: DataFrame, config: LineDedup) -> DataFrame:
    """``id, cluster`` of the lines that are linked."""
    spark = docs.sparkSession

    def joined(links: DataFrame) -> DataFrame:
        return settled(spark, "line-components", lambda: duplicate_clusters(links))

    members = keyed.select(F.col("k1").alias("line"), F.explode("bands").alias("band"))
    pairs = settled(spark, "line-pairs", lambda: _centers(members))
    if pairs.isEmpty():
        return firsts.select(F.col("line").alias("id"), F.col("line").alias("cluster")).limit(0)
    named = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line")))
    named, seen = materialize_counted(named.distinct(), "line-named")
    text = lines_of(docs).select(F.xxhash64("line").alias("line"), F.col("line").alias("own"))
    texts = materialize(
        text.join(F.broadcast(named) if seen["rows"] <= SMALL_ROWS else named, "line", "left_semi")
        .groupBy("line")
        .agg(F.min("own").alias("text")),
        "line-texts",
    )
    sketched = texts.select("line", "text", sketch_hashes(F.col("text"), config).alias("own"))
    texts = materialize(with_bands(sketched, config), "line-banded").withColumnRenamed("text", "own")
    links = settled(spark, "line-links", lambda: _verified(pairs, texts, config))
    components = joined(links)
    more = settled(spark, "line-more", lambda: _across(pairs, components, texts, config))
    return components if more.isEmpty() else joined(links.unionByName(more))


def drop_duplicate_lines(docs: DataFrame, config: LineDedup = LineDedup()) -> DataFrame:
    """``docs`` with only the first line of every component left in ``text``.

    Documents none of whose lines are left have an empty text.
    """
    doc, gone = fresh("doc", docs.columns), fresh("gone", docs.columns)
    lost = (
        line_components(docs, config)
        .where("NOT kept")
        .groupBy(F.col("doc_id").alias(doc))
        .agg(F.sort_array(F.collect_set("line_no")).alias(gone))
    )
    lost = materialize(lost, "line-gone")
    joined = docs.join(lost, docs["doc_id"].cast("long") == lost[doc], "left")
    kept = F.filter(
        F.split(docs["text"], LINE_END, -1), lambda line, i: ~F.array_contains(gone, i)
    )
    text = F.when(F.col(gone).isNull(), docs["text"]).otherwise(F.array_join(kept, LINE_END))
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
