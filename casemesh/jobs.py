"""Command-line jobs for spark-submit: train, index, triage, search, stream.

    spark-submit -m casemesh.jobs train  --history h.csv --models m --index i --holdout
    spark-submit -m casemesh.jobs triage --requests r --models m --index i --out o
    spark-submit -m casemesh.jobs search --requests r --models m --index i --out o --k 5
    spark-submit -m casemesh.jobs stream --requests r --models m --index i --out o --state s

``triage`` and ``stream`` take ``--transcripts`` of media files; ``triage`` also takes a folder
of files (``--media``) beside its requests, and rules of any number (``--rule-table``).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.operators import rules
from casemesh.operators.learn import ForestSettings
from casemesh.operators.neighbours import with_payload
from casemesh.plans.lookup import similar_text
from casemesh.plans.training import train
from casemesh.plans.triage import triage
from casemesh.schemas import REQUEST, RULES
from casemesh.sources.history import read_history
from casemesh.session import scratch_scope
from casemesh.sources.index import check_stamp, index_entries, index_with_model, load_index
from casemesh.sources.models import TriageModels, load_models
from casemesh.sources.media import read_media, read_transcripts
from casemesh.sources.results import write_results
from casemesh.sources.tables import read_table
from casemesh.streaming.triage_stream import triage_stream


def _history(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    if path.endswith(".csv"):
        return read_history(spark, path, multi_line)
    return read_table(spark, path)


def _rules(spark: SparkSession, path: str | None):
    return rules.rules_from_table(spark.read.json(path)) if path else rules.DEFAULT_RULES


def run_train(spark: SparkSession, args) -> dict:
    """Models to ``--models``, labelled cases to ``--index``; scores with ``--holdout``."""
    settings = ForestSettings(num_trees=args.trees, max_depth=args.depth)
    run = train(_history(spark, args.history, args.multi_line), settings, args.holdout, args.models)
    models = run.models
    added = index_with_model(
        index_entries(run.features), args.index, models.fingerprint(), models.featurize
    )
    return {"indexed": added, **run.metrics}


def _artifacts(spark: SparkSession, args) -> tuple[TriageModels, DataFrame]:
    models = load_models(spark, args.models)
    check_stamp(spark, args.index, models.fingerprint())
    return models, load_index(spark, args.index)


def _requests(spark: SparkSession, args) -> DataFrame:
    """The request table, and a request per media file, known by its path."""
    requests = read_table(spark, args.requests)
    if not args.media:
        return requests
    files = read_media(spark, args.media).select(
        F.col("media_path").alias("complaint_id"), "media_path"
    )
    return requests.unionByName(files, allowMissingColumns=True)


def _transcripts(spark: SparkSession, args) -> DataFrame | None:
    return read_transcripts(spark, args.transcripts) if args.transcripts else None


def run_triage(spark: SparkSession, args) -> dict:
    cascade = None
    if args.rule_table:
        cascade = spark.read.schema(RULES).json(args.rule_table)
    elif args.precedence == "text_first":
        cascade = _rules(spark, args.rules)
    models, index = _artifacts(spark, args)
    result = triage(
        _requests(spark, args), models, index, cascade, gate=args.gate, k=args.k,
        precedence=args.precedence, nprobe=args.nprobe, recall=args.recall,
        transcripts=_transcripts(spark, args),
    )
    return write_results(result, args.out)


def run_search(spark: SparkSession, args) -> dict:
    texts = read_table(spark, args.requests).withColumnRenamed("text_input", "complaint_text")
    models, index = _artifacts(spark, args)
    near = similar_text(texts, index, models.text, args.k, metric="l2sq", nprobe=args.nprobe, recall=args.recall)
    with_payload(near, index.drop("embedding")).write.mode("append").parquet(args.out)
    return {}


def run_stream(spark: SparkSession, args) -> dict:
    arriving = spark.readStream.schema(REQUEST)
    if args.files_per_batch:
        arriving = arriving.option("maxFilesPerTrigger", args.files_per_batch)
    models, _ = _artifacts(spark, args)
    query = triage_stream(
        arriving.parquet(args.requests), models, lambda: load_index(spark, args.index), args.out,
        args.state, _rules(spark, args.rules), gate=args.gate, k=args.k, nprobe=args.nprobe,
        recall=args.recall, transcripts=_transcripts(spark, args), available_now=args.once,
    )
    query.awaitTermination()
    return {}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="casemesh.jobs")
    jobs = top.add_subparsers(dest="job", required=True)
    needs = {
        "train": (run_train, ["history", "models", "index"]),
        "triage": (run_triage, ["requests", "models", "index", "out"]),
        "search": (run_search, ["requests", "models", "index", "out"]),
        "stream": (run_stream, ["requests", "models", "index", "out", "state"]),
    }
    for name, (run, paths) in needs.items():
        job = jobs.add_parser(name)
        job.set_defaults(run=run)
        for path in paths:
            job.add_argument(f"--{path}", required=True)
        if name == "train":
            job.add_argument("--trees", type=int, default=ForestSettings.num_trees)
            job.add_argument("--depth", type=int, default=ForestSettings.max_depth)
            job.add_argument("--holdout", action="store_true")
            job.add_argument("--multi-line", action="store_true", help="line breaks in CSV quotes")
        else:
            job.add_argument("--k", type=int, default=2)
            job.add_argument("--nprobe", type=int, help="look into so many nearest cells only")
            job.add_argument("--recall", type=float, help="share of exact matches to find")
        if name in ("triage", "stream"):
            job.add_argument("--gate", type=float, default=rules.GATE)
            job.add_argument("--rules", help="JSON lines with a rules table")
            job.add_argument("--transcripts", help="table of media_path and transcript")
        if name == "triage":
            job.add_argument("--media", help="folder of media files, each a request")
            job.add_argument("--rule-table", help="JSON lines with rules, joined and not compiled")
            choices = ["text_first", "file_first", "flag"]
            job.add_argument("--precedence", choices=choices, default="text_first")
        if name == "stream":
            job.add_argument("--once", action="store_true")
            job.add_argument("--files-per-batch", type=int, default=1000)
    return top


def main(arguments: list[str] | None = None) -> dict:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"casemesh-{args.job}").getOrCreate()
    with scratch_scope(spark):
        report = args.run(spark, args)
    print(report)
    return report


if __name__ == "__main__":
    main()
