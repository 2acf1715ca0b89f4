"""Small tables for the text operators, with clashing extra columns and awkward rows."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names the operators use inside.
CLASHING = ("row", "line", "band", "a", "b", "score", "signature", "_doc", "spans")


def documents(spark, texts, ids=None, langs=None, sources=None, partitions=3):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [
        (i, t, langs[n] if langs else "en", sources[n] if sources else "s", len(t or ""))
        for n, (i, t) in enumerate(zip(ids, texts))
    ]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(partitions)


def clash(docs):
    """The table with extra columns named like those the operators make."""
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit("x") for name in CLASHING})


def components(keys, links):
    """The smallest key of every connected group."""
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in links:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def similar_pairs(sets, percent):
    keys = sorted(sets)
    for n, x in enumerate(keys):
        for y in keys[:n]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                yield y, x
