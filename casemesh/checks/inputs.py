"""The driver's tables seen as complaints, history, vectors and media paths.

Their prose is invented, so the default keywords and gate would never fire on it. The
words and the gate below stand in for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.operators.rules import DEFAULT_RULES, Rule
from casemesh.sources.tables import read_table

SCOPE_WORDS = ("thouou", "menteux", "thinor")
EMERGENCY_WORDS = ("hent", "eau", "anble")
WATER_WORDS = ("ble", "ther", "des")
GATE = 1.25
DUPLICATE_COSINE = 0.95
RECALL = 0.9
QUOTA, FOLDS = 50, 5
MEDIA_WORDS = ("#top", "ref", "utm", "html")


def check_rules() -> tuple[Rule, ...]:
    words = (SCOPE_WORDS, EMERGENCY_WORDS, WATER_WORDS)
    return tuple(
        Rule(r.name, r.order, w, r.officer, r.priority, r.eta_label, r.scope)
        for r, w in zip(DEFAULT_RULES, words)
    )


def check_media_rules() -> tuple:
    return tuple(((word,), f"Media about {word}") for word in MEDIA_WORDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as they lie. A vector join reads its index several times and deals it
    itself, so a table spread over the cores would be shuffled whole for each reading."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def damage(quality, toxic):
    """No document is blank, symbols only or an error, so labels give such requests too."""
    return (
        F.when((quality == 0) & (toxic == 0), "!!! ???")
        .when((quality == 0) & (toxic == 1), "Error: no sound")
        .when((quality == 1) & (toxic == 0), "   ")
    )


def as_requests(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document as a typed request, and one damaged request per label."""
    typed = documents.select(
        F.concat(F.lit("D"), "doc_id").alias("complaint_id"), F.col("text").alias("text_input")
    )
    damaged = labels.select(
        F.concat(F.lit("L"), "doc_id").alias("complaint_id"),
        damage(F.col("quality"), F.col("toxic")).alias("text_input"),
    )
    return typed.unionByName(damaged).withColumn("media_path", F.lit(None).cast("string"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: language routes, labels set the priority, length the days."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    priority = F.when(F.col("toxic") == 1, "High").when(F.col("quality") == 1, "Medium")
    return labelled.select(
        F.concat(F.lit("H"), "doc_id").alias("id"),
        F.col("text").alias("complaint_text"),
        F.concat(F.lit("Officer_"), "lang").alias("assigned_officer"),
        priority.otherwise("Low").alias("priority"),
        (F.col("n_chars") / 1000.0).alias("eta"),
    )


LANGUAGES = ("de", "en", "es", "fr")


def named_vectors(rows: DataFrame) -> DataFrame:
    """Adds an ``embedding`` that names the language of a row: one number per language."""
    return rows.withColumn(
        "embedding", F.array(*[(F.col("lang") == lang).cast("float") for lang in LANGUAGES])
    )


def named_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents whose vectors say everything about their labels."""
    labelled = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").select("doc_id"), "doc_id"
    )
    days = F.when(F.col("lang") == "en", 1.5).when(F.col("lang") == "de", 2.25).otherwise(4.0)
    return named_vectors(labelled).select(
        F.concat(F.lit("H"), "doc_id").alias("id"),
        F.col("text").alias("complaint_text"),
        "embedding",
        F.concat(F.lit("Officer_"), "lang").alias("assigned_officer"),
        F.when(F.col("lang").isin("en", "fr"), "High").otherwise("Low").alias("priority"),
        days.alias("eta"),
    )


def two_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with text, file, both or neither: blank in one language, null in another."""
    documents = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages")
    text = (
        F.when(F.col("lang") == "de", "   ").when(F.col("lang") != "es", F.col("text"))
    )
    return documents.join(pages, F.col("doc_id") == F.col("page_id"), "left").select(
        "doc_id",
        text.alias("text_input"),
        F.col("url").alias("media_path"),
        (F.col("lang") == "fr").alias("is_file"),
    )


WAIT_SECONDS = 600


def awaited_events(documents: DataFrame) -> DataFrame:
    """Documents as events: German ones are typed and sent twice; Spanish ones come as a file
    whose transcript follows, French ones as a file whose transcript came first, some of
    either too far apart; of others only the file comes. Later events move the clock."""
    # Twice the wait between documents, so that the events of one are those of its time.
    second = F.lit(WAIT_SECONDS * 1000) + F.col("doc_id") * 2 * WAIT_SECONDS
    apart = (F.col("doc_id") % 900).cast("long")
    lang = F.col("lang")
    none = F.lit(None).cast("string")
    path = F.concat(F.lit("file"), "doc_id")

    def event(kind, text, path, at):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), path.alias("path"), at.alias("at"))

    typed = F.array(event("request", F.col("text"), none, second), event("request", F.col("text"), none, second))
    file = event("request", none, path, second)
    after = F.array(file, event("transcript", F.col("text"), none, second + apart))
    before = F.array(event("transcript", F.col("text"), none, second - apart), file)
    own = F.when(lang == "de", typed).when(lang == "es", after).when(lang == "fr", before)
    clock = event("clock", none, none, F.lit(1 << 33))
    late = F.when(F.col("doc_id") % 50 == 0, F.array(clock)).otherwise(F.slice(F.array(clock), 1, 0))
    events = F.concat(own.otherwise(F.array(file)), late)
    return documents.select(
        F.concat(F.lit("D"), "doc_id").alias("complaint_id"), F.explode(events).alias("e")
    ).select(
        "complaint_id", "e.kind", "e.text", F.col("e.path").alias("media_path"),
        F.timestamp_seconds("e.at").alias("at"),
    )


def spoken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per turn of a conversation: its first two words as a phrase, and its third."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"))
    forcing = F.col("conv_id") % 5 != 0
    return (
        table(spark, sf_dir, "conversations")
        .select("conv_id", "turn", words.alias("w"))
        .where(F.size("w") >= 3)
        .select(
            F.concat_ws("-", F.lit("R"), "conv_id", "turn").alias("rule"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("priority"),
            F.array(
                F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))), F.get("w", F.lit(2))
            ).alias("keywords"),
            F.when(forcing, F.concat(F.lit("Officer_"), "turn")).alias("officer"),
            F.when(forcing & (F.col("turn") == 0), F.lit("High")).alias("priority_label"),
            F.lit(None).cast("string").alias("eta_label"),
        )
    )
