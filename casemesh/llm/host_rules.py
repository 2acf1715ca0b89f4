"""Host-level quality rules: failures per host, shrunk by an empirical beta prior.

Every text is measured once. A document fails if it is too short or repeats itself. The
failures of a host are a binomial count; over all hosts a beta prior is fitted by moments,
and a host is rejected where the lower bound of its posterior failure rate is above
``max_rate``. The verdict joins back to the documents.

Defined cases: null and empty texts have no words and fail; documents without a host are
judged alone; a single host, or hosts that differ no more than chance, get a strong prior
around the common rate; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.llm.learning import worker_state
from casemesh.llm.words import WHITE, mix, shingles, slices, words
from casemesh.operators.joins import join_unique
from casemesh.session import materialize_counted

# Fixed values of the measures.
SYMBOLS = b"#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(SYMBOLS)] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[10] = True


class HostRules(NamedTuple):
    """``deviations``: how far below the posterior mean the bound lies. ``strongest``:
    the prior is worth at most so many documents."""

    max_rate: float = 0.5
    deviations: float = 2.0
    strongest: float = 10_000.0


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set inside each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def measure(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words, characters in words, symbols, repeated lines and repeated words of each text."""
    texts = len(bounds) - 1
    found = words(data, bounds)
    blank = WHITE[data]
    chars = per_text(~blank & ((data & 0xC0) != 0x80), bounds)
    symbols = per_text(SYMBOL[data], bounds)

    lines = words(data, bounds, separator=NEWLINE)
    filled = np.concatenate([[0], np.cumsum(~blank)])
    worded = filled[lines.end] > filled[lines.start]
    owner = lines.text[worded]
    own = lines.code[worded] ^ mix(owner.astype(np.uint64))
    first = np.unique(own, return_index=True)[1]
    repeated_lines = np.bincount(owner, minlength=texts) - np.bincount(owner[first], minlength=texts)

    code, at = shingles(found, WINDOW)
    own = code ^ mix(found.text[at].astype(np.uint64))
    _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
    again = at[counts[inverse] > 1]
    edges = np.zeros(len(found.code) + WINDOW + 1, dtype=np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    covered = np.cumsum(edges)[: len(found.code)] > 0
    return (
        np.diff(found.first),
        chars,
        symbols,
        repeated_lines,
        per_text(covered, found.first),
    )


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, source`` and the measures of every row, one pass over the texts."""

    def run(batches):
        worker_state("host_rules")
        for batch in batches:
            for part in slices(batch.column(2)):
                rows = part.high - part.low
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.low, rows), batch.column(1).slice(part.low, rows)]
                    + [pa.array(m, pa.int64()) for m in measure(part.data, part.bounds)],
                    names,
                )

    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    names = ["doc_id", "source", *counts]
    schema = "doc_id long, source string, " + ", ".join(f"{c} long" for c in counts)
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    ).mapInArrow(run, schema)


def host_verdicts(measured: DataFrame, rules: HostRules) -> DataFrame:
    """``source, host_docs, host_failed, host_rate, host_kept``: one row per host."""
    hosts = measured.where("source IS NOT NULL").groupBy("source").agg(
        F.count(F.lit(1)).alias("host_docs"),
        F.sum(F.col("base_failed").cast("long")).alias("host_failed"),
    )
    n, f = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(n).alias("n"),
        F.sum(f).alias("f"),
        F.sum(n * n).alias("nn"),
        F.sum(f * f / n).alias("ff"),
    ).first()
    if not sums["k"]:
        return hosts.withColumn("host_rate", F.lit(0.0)).withColumn("host_kept", F.lit(True))
    alpha, beta = beta_prior(sums["k"], sums["n"], sums["f"], sums["nn"], sums["ff"], rules.strongest)
    size = n + F.lit(alpha + beta)
    rate = (f + F.lit(alpha)) / size
    low = rate - F.lit(rules.deviations) * F.sqrt(rate * (1 - rate) / (size + 1))
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", low <= F.lit(rules.max_rate))


def beta_prior(k, n, f, nn, ff, strongest) -> tuple[float, float]:
    """Moments of the hosts' rates: their spread beyond chance sets the prior's weight."""
    mean = f / n
    noise = mean * (1 - mean)
    room = n - nn / n
    between = (ff - mean * f - (k - 1) * noise) / room if room > 0 else 0.0
    weight = noise / between - 1 if between > 0 else strongest
    weight = min(max(weight, 1.0), strongest)
    return mean * weight, (1 - mean) * weight


def apply_host_rules(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """Every row with its measures, ``base_failed``, its host's figures, and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    measured, seen = materialize_counted(
        measures(docs).withColumn("base_failed", failed), "host-measures"
    )
    verdicts = host_verdicts(measured, rules)
    joined = join_unique(measured, verdicts, "source", left_rows=seen["rows"])
    return joined.withColumn(
        "kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))
    )
