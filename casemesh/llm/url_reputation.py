"""URL verdicts: explicit rules first, then empirical-Bayes reputation of the host.

A rule names a host, with all its subdomains, and the beginning of a path; the longest rule
that fits a url decides. Other urls get the verdict of their host. Labelled pages are
counted per host, registered domain and suffix. Each level's rate of bad pages is shrunk to
the level above it by a beta-binomial prior whose weight comes from the spread of the rates
on that level, and a host is blocked where the lower bound of its posterior is above
``max_rate``. A host nobody labelled has the posterior of its domain, or else its suffix.

Defined cases: null urls, and urls without ``://``, have an empty host and path, fit no rule
and are judged by the common rate; without labels everything else is allowed; a page with
several labels counts each; repeated rows all come back; other columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh.operators.joins import join_unique
from casemesh.session import materialize, materialize_counted

ALLOW, BLOCK = "allow", "block"


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Reputation(NamedTuple):
    """``strongest``: a prior is worth at most so many pages. ``double_suffixes``: suffixes
    of two labels, under which a registered domain has three."""

    max_rate: float = 0.5
    deviations: float = 2.0
    strongest: float = 1000.0
    double_suffixes: tuple[str, ...] = ("co.uk", "com.au", "co.jp", "com.br")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(rules: tuple[UrlRule, ...], field: str) -> Column:
    """``field`` of the longest rule that fits columns ``host`` and ``path``, or null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        below = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits = below & F.col("path").startswith(rule.path)
        chosen = F.when(fits, F.lit(getattr(rule, field))).otherwise(chosen)
    return chosen


def with_levels(hosts: DataFrame, double_suffixes: tuple[str, ...]) -> DataFrame:
    """Adds ``domain`` and ``suffix`` to a table of hosts."""
    last = F.substring_index("host", ".", -1)
    last_two = F.substring_index("host", ".", -2)
    doubled = last_two.isin(*double_suffixes)
    return hosts.withColumns({
        "suffix": F.when(doubled, last_two).otherwise(last),
        "domain": F.when(doubled, F.substring_index("host", ".", -3)).otherwise(last_two),
    })


def prior_weight(level: DataFrame, mean: float, strongest: float) -> float:
    """Weight of the prior of a level, from the spread of ``bad / n`` beyond chance."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    row = level.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(n).alias("n"),
        F.sum(n * n).alias("nn"),
        F.sum((bad - n * mean) * (bad - n * mean) / n).alias("spread"),
    ).first()
    noise = mean * (1 - mean)
    room = row["n"] - row["nn"] / row["n"]
    between = (row["spread"] - (row["k"] - 1) * noise) / room if room > 0 else 0.0
    weight = noise / between - 1 if between > 0 else strongest
    return min(max(weight, 1.0), strongest)


def host_reputation(pages: DataFrame, labels: DataFrame, config: Reputation) -> DataFrame:
    """``host, rate, reputable``: one row per host of ``pages`` (``page_id, host``).

    ``labels`` has ``page_id, bad`` (0 or 1).
    """
    outcomes = (
        pages.join(labels.where("bad IS NOT NULL"), "page_id")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    )
    outcomes = materialize(with_levels(outcomes, config.double_suffixes), "url-outcomes")
    total = outcomes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    hosts = with_levels(pages.select("host").distinct(), config.double_suffixes)
    if not total["n"]:
        return hosts.select("host", F.lit(0.0).alias("rate"), F.lit(True).alias("reputable"))
    mean = total["bad"] / total["n"]

    def counts(key: str) -> DataFrame:
        return outcomes.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    rated, above = hosts, F.lit(mean)
    for key in ("suffix", "domain", "host"):
        level = materialize(counts(key), f"url-{key}")
        weight = F.lit(prior_weight(level, mean, config.strongest))
        own = level.select(key, F.col("n").alias(f"n_{key}"), F.col("bad").alias(f"bad_{key}"))
        n = F.coalesce(F.col(f"n_{key}"), F.lit(0))
        bad = F.coalesce(F.col(f"bad_{key}"), F.lit(0))
        rated = rated.join(own, key, "left").withColumns({
            f"rate_{key}": (bad + weight * above) / (n + weight),
            "size": n + weight,
        })
        above = F.col(f"rate_{key}")
    low = above - F.lit(config.deviations) * F.sqrt(above * (1 - above) / (F.col("size") + 1))
    return rated.select("host", above.alias("rate"), (low <= F.lit(config.max_rate)).alias("reputable"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: tuple[UrlRule, ...],
    config: Reputation = Reputation(),
) -> DataFrame:
    """``page_id, host, path, rule, verdict, rate`` for every row of ``pages``."""
    parsed = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    parsed, seen = materialize_counted(parsed, "url-parts")
    known = materialize(host_reputation(parsed, labels, config), "url-hosts")
    joined = join_unique(parsed, known, "host", left_rows=seen["rows"])
    by_host = F.when(F.col("reputable"), ALLOW).otherwise(BLOCK)
    return joined.select(
        "page_id",
        "host",
        "path",
        rule_for(rules, "name").alias("rule"),
        F.coalesce(rule_for(rules, "verdict"), by_host).alias("verdict"),
        "rate",
    )
