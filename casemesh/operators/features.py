"""Text to vectors: a fitted MLlib pipeline, or the user's own encoder or vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemesh.session import materialize

# Fixed value: the width of the vectors.
WIDTH = 384
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def text_pipeline(
    text: str = "complaint_text", features: str = "features", width: int = WIDTH
) -> Pipeline:
    """Hashed term counts, weighted by inverse document frequency, at unit length.

    Every stage works within a row; fitting is one pass that counts documents per bucket.
    """
    return Pipeline(
        stages=[
            RegexTokenizer(
                inputCol=text, outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False
            ),
            HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=width),
            IDF(inputCol="_counts", outputCol="_weighted"),
            Normalizer(inputCol="_weighted", outputCol=features),
        ]
    )


def fit_text(df: DataFrame, text: str = "complaint_text", width: int = WIDTH) -> PipelineModel:
    return text_pipeline(text, width=width).fit(df.where(F.col(text).isNotNull()).select(text))


def fit_featurize(
    df: DataFrame, text: str = "complaint_text", width: int = WIDTH, keep_text: bool = True
) -> tuple[PipelineModel, DataFrame]:
    """Fits the text pipeline on ``df`` and adds its ``features``, reading the text once.

    The hashed counts, which are small beside the text, are written between the pass that
    makes them and the two that use them; the text itself only with ``keep_text``.
    """
    tokenizer, hasher, idf, normalizer = text_pipeline(text, width=width).getStages()
    counts = hasher.transform(tokenizer.transform(df.where(F.col(text).isNotNull())))
    unused = ["_tokens"] if keep_text else ["_tokens", text]
    table = materialize(counts.drop(*unused), "term-counts")
    weigher = idf.fit(table)
    model = PipelineModel(stages=[tokenizer, hasher, weigher, normalizer])
    return model, normalizer.transform(weigher.transform(table)).drop("_counts", "_weighted")


def featurize(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds the vector column ``features``."""
    return model.transform(df).drop("_tokens", "_counts", "_weighted")


def featurize_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Adds ``features`` from vectors the user already has."""
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def featurize_with(
    df: DataFrame,
    make_encoder: Callable[[], Callable],
    text: str = "complaint_text",
    batch_size: int = 256,
) -> DataFrame:
    """Adds ``features`` from an encoder loaded once per Python worker, fed Arrow batches.

    ``make_encoder()`` returns a function from a numpy array of texts to a matrix.
    """
    encode = predict_batch_udf(
        make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    encoded = df.withColumn("_encoded", encode(F.col(text)))
    return featurize_vectors(encoded, "_encoded").drop("_encoded")


def as_array(features: Column, dtype: str = "float64") -> Column:
    return vector_to_array(features, dtype)
